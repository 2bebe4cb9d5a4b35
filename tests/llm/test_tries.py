"""Exact duplicates against plain grouping, also when the hash hardly tells texts apart and when tries spill."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellsmith.llm import trie_dedup
from cellsmith.llm.trie_dedup import Owner, Trie

DIGESTS = {"sha256": trie_dedup.sha256, "first char": lambda t: F.substring(t, 1, 1), "none": lambda t: F.lit("")}


def plain(rows, largest=True):
    """text -> (id that stays, rows)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {t: ((max if largest else min)((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def check(docs, **how):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = plain(rows, how.get("largest", True))
    made = trie_dedup.mark_duplicates(docs, carry=["doc_id", "text"], **how).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in made))) == sorted(map(repr, rows))
    stay = defaultdict(list)
    for r in made:
        assert (r["keep_id"], r["group_size"]) == want[r["text"] or ""]
        if r["kept"]:
            stay[r["text"] or ""].append(r["doc_id"])
    assert {t: [k] for t, (k, _) in want.items()} == stay
    return made


@pytest.mark.parametrize("digest", DIGESTS)
def test_edges(edge_docs, no_docs, digest):
    made = check(edge_docs, digest=DIGESTS[digest])
    if digest == "sha256":
        assert all(r["text_digest"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in made)
    assert trie_dedup.mark_duplicates(no_docs, digest=DIGESTS[digest]).collect() == []


def test_names_clash(edge_docs):
    clashing = edge_docs.withColumn("keep_id", F.lit(1)).withColumn("size", F.lit("x")).withColumn("a.b", F.lit(2))
    made = trie_dedup.mark_duplicates(clashing)
    assert made.columns == [*[c for c in clashing.columns if c != "text"], "keep_id_1", "group_size", "kept_1", "text_digest"]
    assert made.count() == edge_docs.count()
    left = trie_dedup.drop_duplicates(clashing)
    assert left.columns == clashing.columns and left.count() == len(plain([(r["doc_id"], r["text"]) for r in edge_docs.collect()]))


def test_hot_text(spark):
    """A third of the rows is one text, a third has no id, ids repeat."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 != 1, F.floor(F.col("id") / 4)).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("text"),
    )
    check(docs.repartition(7))
    check(docs, largest=False)


def test_spill(spark):
    """Tries of a few hundred bytes give the same owners as large ones."""
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) * rnd.choice([1, 40])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r)[:2] + tuple(r)[3:6] for r in trie_dedup.owners(docs, held=900).collect())
    assert got == sorted(tuple(r)[:2] + tuple(r)[3:6] for r in trie_dedup.owners(docs).collect())
    assert len(got) == len({t for _, t in rows}) and sum(r[-1] for r in got) == 2000


@pytest.mark.parametrize("most", [0, 2_000, 20_000])
def test_trie_spills_subtrees(most):
    rnd = random.Random(most)
    trie, said, given = Trie(), defaultdict(int), defaultdict(int)
    for i in range(800):
        text = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12)))
        said[text] += 1
        trie.insert(text, Owner(i, 1, 1, ""))
        if trie.held > most:
            for end, owner in trie.spill(most // 2):
                given[end] += owner.rows
            assert trie.held <= most // 2
    for end, owner in trie.clear():
        given[end] += owner.rows
    assert given == said and trie.held == 0
