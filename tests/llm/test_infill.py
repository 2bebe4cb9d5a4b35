"""Fill-in-the-middle against plain Python, and the exact way back."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from cellsmith.llm import infill
from cellsmith.llm.infill import Infill

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = ["", None, "abc", "\n", "a\r\nb c", "$1 \\ $", "<P", "x<S", "<<S>", "a<M>b", "<P>", "🙂🙂 x", "A" * 70_000, "a " * 40_000, "1" * 50_000, "(?s)\\A{3}"]


def plain(doc_id, text, rule):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.transformed:
        return len(units), "plain", None, None, text
    if h[3] % 100 < rule.suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(docs, rule=Infill()):
    made = infill.fill_in_middle(docs, rule)
    names = made.columns[len(docs.columns) :]
    back = infill.restore(F.col(names[4]), F.col(names[1]))
    rows = made.withColumn("_back", back).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[n] for n in names) == plain(r["doc_id"], r["text"], rule)
        assert r["_back"] == (r["text"] or "")
    return Counter(r[names[1]] for r in rows)


def test_edges(edge_docs, no_docs):
    check(edge_docs.withColumn("form", F.lit("x")).withColumn("output", F.lit("y")).withColumn("a.b", F.lit(1)))
    assert infill.fill_in_middle(no_docs).collect() == []


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t) for i in range(8) for t in ODD], "doc_id bigint, text string")
    forms = check(docs, Infill(seed=3, transformed=100, suffix_first=50))
    assert set(forms) == {"plain", "psm", "spm"}
    assert set(check(docs, Infill(transformed=0))) == {"plain"}
    assert "psm" not in check(docs, Infill(transformed=100, suffix_first=100))


def test_shares(spark):
    forms = check(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two, three.").alias("text")))
    assert abs(forms["plain"] / 4000 - 0.1) < 0.02 and abs(forms["spm"] / 4000 - 0.18) < 0.03


def test_parts_cover_every_cut(spark):
    """Empty prefix, middle and suffix all occur."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("ab c").alias("text"))
    made = infill.fill_in_middle(docs).filter("form != 'plain'").select("prefix_chars", "middle_chars").distinct().collect()
    assert {(r[0], r[1]) for r in made} == {(a, b - a) for a in (0, 2, 3, 4) for b in (0, 2, 3, 4) if b >= a}
