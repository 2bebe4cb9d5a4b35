"""The source audit against dense plain arithmetic."""

import re
from collections import Counter, defaultdict
from itertools import islice

from cellsmith.llm import divergence
from cellsmith.llm.divergence import Audit, Summarizer, vector_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, audit):
    """Every kept term of every group, present or not."""
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    seen, in_group, in_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        seen[lang or ""].update(set(terms))
        in_lang[lang or ""].update(terms)
        in_group[lang or "", source or ""].update(terms)
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in seen[lang].items() if n >= audit.min_df)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + audit.scale * (counts[t] + audit.prior) // (total + audit.prior * len(kept)) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        mine = shares(in_group[lang, source])
        pairs = []
        for other in [s for x, s in groups if x == lang and s != source]:
            theirs = shares(in_group[lang, other])
            pairs.append((other, sum(apart(mine[t], theirs[t]) for t in kept)))
        whole = shares(in_lang[lang])
        terms = [(t, apart(mine[t], whole[t])) for t in kept if in_group[lang, source][t] and mine[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, audit.top)):
            order = sorted(items, key=lambda i: (-i[1], i[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in islice(enumerate(order, 1), most)]
    return Counter((*r[:5], r[5]) for r in out)


def check(docs, audit):
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.select("lang", "source", "text").collect()]
    got = divergence.audit_sources(docs, audit).collect()
    assert Counter(map(tuple, got)) == plain(rows, audit)
    return got


def test_edges(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F

    docs = edge_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("term", F.lit("x")).withColumn("total", F.lit(1))
    assert check(docs, Audit(min_df=1))
    assert check(docs, Audit(min_df=2, top=3))
    none = check(docs, Audit(min_df=1000))
    assert none and {(r["part"], r["value"]) for r in none} == {("pair", 0)}
    assert divergence.audit_sources(no_docs.withColumn("lang", F.lit("en"))).collect() == []


def test_cases(spark):
    """Ties, a source without kept terms, NULL lang, letters beyond ASCII (which keep their case), a hot source, a long text."""
    rows = [("en", "hot", f"alpha beta w{i % 3} Beta") for i in range(60)]
    rows += [("en", "b", "alpha gamma ALPHA"), ("en", "b", "gamma beta"), ("en", "bare", "123 --"), ("en", "bare", None), ("en", "one", "solo")]
    rows += [(None, "x", "É é É_é a漢b"), (None, None, "É alpha"), (None, "y", ""), ("de", "only", "ein Wort"), ("zz", "long", "ab " * 50_000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    for audit in (Audit(min_df=1), Audit(min_df=2), Audit(min_df=10), Audit(min_df=1, top=1, scale=1000, prior=1)):
        check(docs, audit)


def test_large_counts_stay_exact(spark):
    """Shares of counts whose scaled product is far beyond 64 bits."""
    rows = spark.createDataFrame([(4_000_000_000_000, 9_000_000_000_000, 3)], "n bigint, total bigint, terms bigint")
    share = rows.select(divergence._share("n", "total", "terms", Audit())).first()[0]
    assert share == 1 + 1_000_000_000 * 4_000_000_000_002 // 9_000_000_000_006


def test_summarizer_hands_on(spark):
    """A held bound of a few entries changes nothing but the number of partial sums."""
    docs = spark.createDataFrame([("en", f"s{i % 4}", f"a b{i % 7} a c{i}") for i in range(100)], "lang string, source string, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(divergence.group_sums(docs, most=3)) == key(divergence.group_sums(docs))
    held = Summarizer(2)
    held.add(("en", "s"), vector_of("a B b".encode()))
    assert held.full and [b.num_rows for b in held.give_out()] == [2] and not held.full
