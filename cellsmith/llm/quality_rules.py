"""Quality rules: counts of each text, and a log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import bind, col, fresh, text_of, words_of

#: Fixed by the query contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PCT = 30


@dataclass(frozen=True)
class Ratio:
    """``order``: the most words in an n-gram, all shorter ones count as well; ``buckets`` (a power of two) that n-grams are hashed to;
    ``prior``: raw-corpus counts mixed into the trusted counts of a bucket, so that unseen n-grams weigh little; ``least``: mean
    log ratio of a word's n-grams below which a document is rejected."""

    order: int = 2
    buckets: int = 1 << 18
    prior: float = 1.0
    least: float = -0.15


def letters(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, ""))


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(worded, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def runs(hashes: Column, width: int) -> Column:
    """64-bit hash of each word with the ``width`` - 1 words after it; past the end there is nothing to add."""
    if width == 1:
        return hashes
    return F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, width)]))


def ngrams(hashes: Column, order: int) -> Column:
    """Hashes of all n-grams of 1 to ``order`` words."""
    return F.concat(*[runs(hashes, k) for k in range(1, order + 1)])


def window_hashes(hashes: Column, width: int = WINDOW) -> Column:
    """Hashes of all whole windows of ``width`` words; equal windows are found by them."""
    return F.slice(runs(hashes, width), F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text.

    Windows sorted by hash show their repeats next to each other; sorted back by place,
    each repeated window adds the words up to the next one, ``width`` at most.
    """

    def repeats(sorted_: Column) -> Column:
        same = lambda x, k: F.get(sorted_, k)["h"] == x["h"]
        twice = F.filter(sorted_, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(bind(placed, repeats), covered))

    return bind(hashes, count)


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def bucket(hashed: Column, ratio: Ratio) -> Column:
    return hashed.bitwiseAND(F.lit(ratio.buckets - 1)).cast("int")


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, ratio: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row with ``weights``: array of ``buckets`` log ratios, trusted over raw.

    ``trusted_ids``: one column of ids; the text of every one of them is trusted, the raw
    counts are those of every document. Both come from one pass that is pre-aggregated by
    bucket. Ids meet their documents by a shuffle, as their number grows with the input;
    documents without an id meet none and are spread by their text.
    """
    ids = trusted_ids.toDF("id").filter("id is not null").distinct()
    ids = ids.select("id", F.lit(0).cast("bigint").alias("spread"), F.lit(1).alias("trusted"))
    texts = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    texts = texts.withColumn("spread", F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint")))
    marked = texts.join(ids.hint("shuffle_hash"), ["id", "spread"], "left")
    grams = marked.select("trusted", F.explode(bind(word_hashes(F.col("text")), lambda h: ngrams(h, ratio.order))).alias("h"))
    grams = grams.select("trusted", bucket(F.col("h"), ratio).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    every = docs.sparkSession.range(ratio.buckets).join(counts, F.col("id") == F.col("b"), "left").fillna(0)
    table = F.sort_array(F.collect_list(F.struct("id", "raw", "good")))
    sums = every.agg(table.alias("t"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    mass = F.lit(ratio.prior * ratio.buckets)

    def log_ratio(r: Column) -> Column:
        raw = (r["raw"] + 1.0) / (F.col("n_raw") + F.lit(float(ratio.buckets)))
        return F.ln((r["good"] + mass * raw) / (F.col("n_good") + mass)) - F.ln(raw)

    return sums.select(F.transform("t", log_ratio).alias("weights"))


def findings(text: Column, weights: Column, ratio: Ratio) -> Column:
    """Counts, mean log ratio and verdict of a text as one struct; every part is computed once."""

    def measure(words: Column, hashes: Column, weights: Column) -> Column:
        total = F.aggregate(ngrams(hashes, ratio.order), F.lit(0.0), lambda a, g: a + F.get(weights, bucket(g, ratio)))
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            letters(words).cast("bigint").alias("word_chars"),
            symbols(text).cast("bigint").alias("n_symbols"),
            repeated_lines(text).cast("bigint").alias("n_dup_lines"),
            repeated_words(window_hashes(hashes)).cast("bigint").alias("n_repeat_words"),
            F.when(F.size(words) > 0, total / (F.size(words) * ratio.order)).otherwise(0.0).alias("mean_ratio"),
        )

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_PCT * m["n_words"])
        return F.struct(m.alias("m"), failed.alias("base_failed"), (~failed & (m["mean_ratio"] >= ratio.least)).alias("kept"))

    hashed = lambda words: bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: measure(words, h, weights))
    return bind(bind(words_of(text), hashed), verdict)


def judge(docs: DataFrame, weights: DataFrame, ratio: Ratio = Ratio(), id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Counts and verdict of every document; with ``keep``, the kept rows with their own columns instead.

    ``weights`` is the one row of ``fit_ratio`` and enters as a scalar subquery of fixed
    size. A document fails with fewer than LEAST_WORDS words or more than MOST_REPEAT_PCT
    percent of its words in repeated windows; of the others, those whose mean log ratio
    per n-gram is below ``ratio.least`` are rejected. Everything is computed in the row.

    NULL or empty text: no words, so it fails. NULL ids and repeated rows are judged as
    any row; an empty table gives an empty result. Without trusted text every ratio is 0.
    """
    base = docs if keep else docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col))
    weighed, got = fresh(base.columns, "_weights"), fresh(base.columns, "_found")
    rows = base.withColumn(weighed, weights.scalar())
    rows = rows.withColumn(got, findings(text_of(text_col), col(weighed), ratio))
    if keep:
        return rows.filter(col(got)["kept"]).select(*[col(c) for c in docs.columns])
    return rows.select(
        "doc_id",
        *[col(got)["m"][k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        col(got)["base_failed"].alias("base_failed"),
        col(got)["kept"].alias("kept"),
        F.round(col(got)["m"]["mean_ratio"], 9).alias("mean_ratio"),
    )
