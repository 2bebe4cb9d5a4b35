"""How far the sources of a language lie apart in their words, and which words set a source apart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.llm.common import rows_at_most, text_of
from cellsmith.session import checkpointed

#: Fixed by the query contract: a term is a run of ASCII letters and characters beyond ASCII.
#: In UTF-8 these are the bytes of letters and those from 128 on; all others become blanks.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(b if b >= 128 or chr(b) in LOWER else b + 32 if chr(b) in UPPER else 32 for b in range(256))
#: Entries that a task holds before it hands on partial sums.
HELD = 1 << 17
#: Groups whose sums are broadcast, some 200 bytes each; more meet by shuffle.
NEAR_GROUPS = 50_000


@dataclass(frozen=True)
class Audit:
    """A language keeps the terms in at least ``min_df`` of its documents, without a limit to their number.

    A count is smoothed by ``prior`` and scaled to a whole number of at most 1 + ``scale``; ``top`` terms are reported a source.
    """

    min_df: int = 10
    scale: int = 1_000_000_000
    prior: int = 2
    top: int = 10


class Summarizer:
    """Sums and numbers of non-zeros of the sparse vectors of each group, until they are given out.

    Bounded by ``most`` entries, of 64 bytes of term each: when it is full, terms of a single document go out as partial
    sums, and all others too if that does not halve it.
    """

    SCHEMA = "lang string, source string, term string, n bigint, docs bigint"

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.groups: dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]] = {}

    def add(self, group: tuple[str, str], vector: Counter) -> None:
        sums, docs = self.groups.setdefault(group, ({}, {}))
        for term, n in vector.items():
            if term in sums:
                sums[term] += n
                docs[term] += 1
            else:
                sums[term], docs[term] = n, 1
                self.held += 1 + len(term) // 64

    @property
    def full(self) -> bool:
        return self.held >= self.most

    def give_out(self, rare: bool = False) -> Iterator[pa.RecordBatch]:
        """What is held, or only the terms that one document of a group had."""
        for (lang, source), (sums, docs) in self.groups.items():
            out = [t for t, n in docs.items() if n == 1] if rare else list(sums)
            if out:
                names = [pa.array([name] * len(out), pa.string()) for name in (lang, source)]
                counts = [pa.array([d.pop(t) for t in out], pa.int64()) for d in (sums, docs)]
                self.held -= sum(1 + len(t) // 64 for t in out)
                yield pa.RecordBatch.from_arrays([*names, pa.array(out, pa.binary()).cast(pa.string()), *counts], names=["lang", "source", "term", "n", "docs"])

    def make_room(self) -> Iterator[pa.RecordBatch]:
        yield from self.give_out(rare=True)
        if 2 * self.held > self.most:
            yield from self.give_out()
            self.groups.clear()


def vector_of(text: bytes) -> Counter:
    """The exact sparse count vector of a whole text. It names its terms instead of numbering them, so no vocabulary has to fit the driver."""
    return Counter(text.translate(_TERM_BYTES).split())


def group_sums(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): summed vectors and numbers of non-zeros of each group, for the terms that it has.

    NULL text, lang and source are ''. Tasks hand on partial sums, common terms once, which meet by language and term;
    so the sources of a term are together, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Summarizer(most)
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.add((lang, source), vector_of(text))
                if held.full:
                    yield from held.make_room()
        yield from held.give_out()

    picked = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("text"))
    partial = picked.mapInArrow(run, Summarizer.SCHEMA).repartition("lang", "term")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str, audit: Audit) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)) without rounding; NULL if the language keeps no term."""
    return F.expr(
        f"1 + (cast({n} + {audit.prior} as decimal(20,0)) * cast({audit.scale} as decimal(10,0))"
        f" div nullif(cast({total} + {audit.prior} * {terms} as decimal(20,0)), 0))"
    )


def _apart(p: str, q: str) -> Column:
    """Symmetric in both shares."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def audit_sources(
    docs: DataFrame, audit: Audit = Audit(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source of the language, ``term`` rows for the
    ``top`` terms that are commoner in the source than in its language.

    Vectors are summed in the tasks and then by (language, term), so a hot source is no hot task, and what the document
    frequency decides needs no further shuffle. Terms that both sources of a pair have meet by (language, term), one row a source; a term that one of them lacks counts through
    the histogram of the other's counts, and terms that both lack are a product. So a pair costs what is non-zero.

    NULL text, lang and source are ''. A group without kept terms still has its pair rows; a language that keeps no term gives 0
    for each pair. Repeated rows are documents of their own, ids are not read, ties in value rank by item (UTF-8 bytes), an
    empty table gives an empty result, other columns are not read.
    """
    of_term = Window.partitionBy("lang", "term")
    sums = group_sums(docs, lang_col, source_col, text_col)
    sums = sums.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term))
    kept = checkpointed(sums.filter(F.col("docs") >= audit.min_df).drop("docs"))

    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    by_lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    occurring = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    groups = occurring.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "own", "lang_total", "terms"])
    groups = checkpointed(groups.withColumn("least", _share("0", "total", "terms", audit)))
    near = F.broadcast(groups) if rows_at_most(groups, NEAR_GROUPS) else groups

    shares = kept.join(near, ["lang", "source"]).withColumn("p", _share("n", "total", "terms", audit))
    lead = shares.withColumn("q", _share("lang_n", "lang_total", "terms", audit)).filter("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = lead.select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    top = top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= audit.top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    top = top.withColumn("part", F.lit("term")).select(columns)

    one = groups.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "own", "least")], "terms")
    other = groups.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "own", "least")])
    other = F.broadcast(other) if near is not groups else other
    pairs = one.join(other, "lang").filter("source_a < source_b")

    # Every term of a against what b gives a term that it lacks, by the histogram of a's shares.
    bars = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("bar"))
    against = bars.join(near.select("lang", F.col("source").alias("lacking"), F.col("least").alias("q")), "lang").filter("source != lacking")
    alone = against.withColumn("v", F.col("bar") * _apart("p", "q")).groupBy("lang", "source", "lacking").agg(F.sum("v").alias("alone"))

    # Terms that both have: what they add, and what the histograms counted for them too much.
    a = shares.select("lang", "term", F.col("source").alias("source_a"), F.col("p").alias("p_a"), F.col("least").alias("least_a"))
    b = shares.select("lang", "term", F.col("source").alias("source_b"), F.col("p").alias("p_b"), F.col("least").alias("least_b"))
    met = a.join(b, ["lang", "term"]).filter("source_a < source_b")
    gain = _apart("p_a", "p_b") - _apart("p_a", "least_b") - _apart("least_a", "p_b")
    common = met.groupBy("lang", "source_a", "source_b").agg(F.sum(gain).alias("gain"), F.count("*").alias("common"))

    def lone(has: str, lacks: str, name: str) -> DataFrame:
        return alone.select("lang", F.col("source").alias(has), F.col("lacking").alias(lacks), F.col("alone").alias(name))

    keys = ["lang", "source_a", "source_b"]
    evaluated = pairs.join(common, keys, "left").join(lone("source_a", "source_b", "alone_a"), keys, "left")
    evaluated = evaluated.join(lone("source_b", "source_a", "alone_b"), keys, "left").na.fill(0, ["gain", "common", "alone_a", "alone_b"])
    neither = F.coalesce(F.expr("terms - own_a - own_b + common") * _apart("least_a", "least_b"), F.lit(0))
    evaluated = evaluated.withColumn("value", F.col("gain") + F.col("alone_a") + F.col("alone_b") + neither)
    side = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    both_ways = F.explode(F.array(side("source_a", "source_b"), side("source_b", "source_a")))
    sided = evaluated.select("lang", both_ways.alias("s"), "value").select("lang", "s.*", "value")
    sided = sided.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair")).select(columns)
    return sided.unionByName(top)
