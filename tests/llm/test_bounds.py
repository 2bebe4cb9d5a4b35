"""Every operator on the edge table and on an empty one: rows in, rows out, defined results."""

import os

import public_tokenizers
import pytest

import corpus_pipeline
from cellsmith.llm import bpe, html_extract, mixing, ngram_join, pii, quality_rules, ranking, sharding, simhash

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def rules(docs, labels, keep=False):
    ids = labels.filter("quality = 1").select("doc_id")
    return quality_rules.judge(docs, quality_rules.fit_ratio(docs, ids, quality_rules.Ratio()), keep=keep)


OPERATORS = {
    "simhash": lambda d, _: simhash.fingerprint_documents(d),
    "pii": lambda d, _: pii.detect(d),
    "rules": lambda d, labels: rules(d, labels),
    "bpe": lambda d, _: bpe.decode_documents(bpe.encode_documents(d, TOKENIZER), TOKENIZER),
    "ranking": lambda d, labels: ranking.score_documents(d, ranking.fit_quality(d, labels)),
    "sharding": lambda d, _: sharding.shard_documents(d, 24),
    "ngram_join": lambda d, _: ngram_join.near_duplicates(d),
    "pages": lambda d, _: html_extract.extract_pages(d, "doc_id", "source", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_stays(name, edge_docs, no_docs, few_labels):
    made = OPERATORS[name](edge_docs, few_labels)
    assert made.count() == edge_docs.count()
    assert OPERATORS[name](no_docs, few_labels).collect() == []


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stage_bounds(spark, tmp_path, place, edge_docs, no_docs, few_labels):
    few_labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[place]
    made = stage(spark, edge_docs, str(tmp_path))
    if name != "bpe":
        assert made.columns == edge_docs.columns
    made.collect()
    assert stage(spark, no_docs, str(tmp_path)).collect() == []


def test_mixing_bounds(edge_docs, no_docs):
    mix = mixing.Mix(entropy=0.9, repeats=3.0)
    rows = mixing.mix_documents(edge_docs, mix).collect()
    assert {r["source"] for r in rows} <= {"", "s0", "s1", "s2"}
    assert mixing.mix_documents(no_docs, mix).collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert len(names) == 13 and "pipeline" in entry.queries()


def test_rest_imports_without(tmp_path):
    """The entry module works when the folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for part in ("cellsmith", "workload"):
        shutil.copytree(f"{here}/{part}", tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_sets_of_many_blocks_are_sent_in_bounded_batches(spark, monkeypatch):
    """A set that meets many parts goes to many blocks; a batch holds no more than the slice and one set."""
    from cellsmith.llm import ngram_join

    sent, made = [], ngram_join.pa.RecordBatch.from_arrays

    class Batches:
        @staticmethod
        def from_arrays(columns, names):
            if names == ["block", "key", "tokens"]:
                sent.append(sum(len(t.as_py()) for t in columns[2]))
            return made(columns, names=names)

    texts = [" ".join(f"w{k % 97}x{i}" for k in range(200)) for i in range(40)]
    batch = ngram_join.pa.RecordBatch.from_pydict({"text": texts, "key": list(range(40)), "blocks": [[f"b{j}" for j in range(50)]] * 40})
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(ngram_join.pa, "RecordBatch", Batches)
    rows = [r for out in ngram_join.to_blocks(iter([batch]), ngram_join.Likeness()) for r in out.to_pylist()]
    one = 8 * max(len(r["tokens"]) // 8 for r in rows)
    assert len(rows) == 2000 and max(sent) <= (1 << 14) + one
