"""Mixing sources to target weights: tempered shares, then budgeted passes over permuted blocks."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.llm.common import col, fresh, md5_long, text_of, words_of
from cellsmith.operators.lookup import lookup_join
from cellsmith.session import checkpointed

#: Documents that a block holds on average; a hot source has as many blocks as it needs.
BLOCK_DOCS = 2048
#: Each round of the search tries so many exponents in one aggregate.
SECTIONS, ROUNDS = 64, 5


@dataclass(frozen=True)
class Mix:
    """Goals of a mixture. ``entropy``: least entropy of the weights, as a share of that of equal weights.
    ``repeats``: how often a source may be passed at most; it wins over ``entropy``. ``budget``: tokens to
    draw, as a multiple of the corpus; None: the least that passes every source once, so nothing is lost."""

    entropy: float | None = None
    repeats: float | None = None
    budget: float | None = 1.0


def _tempered(sources: DataFrame, exponents: Column) -> DataFrame:
    """One row per exponent: norm, entropy, and the extremes of weight over share."""
    power = F.pow("share", F.col("a"))
    return (
        sources.select("share", F.explode(exponents).alias("a"))
        .groupBy("a")
        .agg(
            F.sum(power).alias("z"),
            F.sum(power * F.ln("share")).alias("s"),
            F.max(F.pow("share", F.col("a") - 1)).alias("most"),
            F.min(F.pow("share", F.col("a") - 1)).alias("least"),
            F.count("*").alias("n"),
        )
        .withColumn("entropy", F.ln("z") - F.col("a") * F.col("s") / F.col("z"))
    )


def solve_exponent(sources: DataFrame, mix: Mix) -> float:
    """The largest exponent in 0..1 whose weights reach the entropy, raised as far as the repetition limit needs.

    ``sources``: one row per source with its token share. Both goals are monotone in the
    exponent, so each round keeps the section that holds the border. Only the rows of one
    round reach the driver. Without goals, or without tokens, the exponent is 1.
    """

    def search(flat_enough) -> float:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            seen = sorted(_tempered(sources, F.array(*[F.lit(a) for a in grid])).collect(), key=lambda r: r["a"])
            good = [flat_enough(r) for r in seen]
            if not seen or all(good):
                return high
            if not good[0]:
                return low
            k = good.index(False)
            low, high = seen[k - 1]["a"], seen[k]["a"]
        return low

    exponent = 1.0 if mix.repeats is None else 0.0
    if mix.entropy is not None:
        exponent = search(lambda r: r["entropy"] >= mix.entropy * log(r["n"]) - 1e-12)
    if mix.repeats is not None:

        def too_often(r) -> bool:
            most = r["most"] / r["least"] if mix.budget is None else mix.budget * r["most"] / r["z"]
            return most > mix.repeats

        exponent = max(exponent, search(too_often))
    return round(exponent, 6)


def source_budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """(source, tokens, docs, weight, budget): one row per source; ``rows`` has source and tokens."""
    sums = checkpointed(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = sums.filter("tokens > 0").withColumn("share", F.col("tokens").cast("double") / F.lit(float(max(total, 1))))
    exponent = solve_exponent(shares, mix)
    fit = _tempered(shares, F.array(F.lit(exponent))).first()
    norm, least = (fit["z"], fit["least"]) if fit else (1.0, 1.0)
    drawn = float(total) * (norm / least if mix.budget is None else mix.budget)
    weight = F.pow("share", F.lit(exponent)) / F.lit(norm)
    return shares.select(
        "source", "tokens", "docs", weight.alias("weight"), F.floor(F.lit(drawn) * weight + 0.5).cast("bigint").alias("budget")
    )


def mix_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """One row per drawn document and pass: doc_id, source, n_tokens, pass, block, slot (``keep``: all columns of ``docs`` instead).

    A token is a word. Every source gets a budget of tokens from its tempered share.
    Its documents lie in blocks by a hash of id and text; each pass goes through the blocks
    in an order of its own. Whole passes are drawn while the budget lasts; the last pass
    takes documents as long as the tokens before them stay below what is left. ``block``
    is the place of the block in its pass, ``slot`` the place in the block. Only block
    totals are ordered per source; documents are ordered within blocks, so a source
    with a third of the rows is no hot task.

    NULL text: no tokens; such documents go with their block. NULL source: the source
    with the empty name. A source without any token is never drawn, and an empty table
    gives an empty result. Repeated rows are documents of their own.
    """
    names = {k: fresh(docs.columns, f"_mix_{k}") for k in ("source", "tokens", "hash", "row")}
    source, tokens, hashed = names["source"], names["tokens"], names["hash"]
    held = docs if keep else docs.select(col(id_col), col(text_col), col(source_col))
    count = F.size(words_of(text_of(text_col))).cast("bigint")
    keyed = held.withColumns(
        {
            source: F.coalesce(col(source_col).cast("string"), F.lit("")),
            tokens: count,
            hashed: md5_long(F.concat(F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit("|"), text_of(text_col))),
        }
    )
    if not keep:
        keyed = checkpointed(keyed.select(col(id_col).cast("bigint").alias("doc_id"), source, tokens, hashed))
        light = keyed
    else:
        light = checkpointed(keyed.select(source, tokens, hashed))
    light = light.select(F.col(source).alias("source"), F.col(tokens).alias("tokens"), F.col(hashed).alias("hash"))
    budgets = checkpointed(source_budgets(light, mix).withColumn("blocks", F.ceil(F.col("docs") / F.lit(BLOCK_DOCS)).cast("bigint")))

    block = F.pmod(F.col("hash"), F.col("blocks"))
    small = budgets.select("source", "blocks", "docs")
    sizes = lookup_join(light, small, ["source"], "docs", "inner").groupBy("source", block.alias("block")).agg(F.sum("tokens").alias("size"))
    ranked = Window.partitionBy("source", "pass").orderBy("turn", "block")
    passes = (
        sizes.join(budgets.select("source", "tokens", "budget"), "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor(F.col("budget") / F.col("tokens")).cast("int"))))
        .withColumn("turn", md5_long(F.concat_ws("|", "source", F.col("pass").cast("string"), F.col("block").cast("string"))))
        .withColumn("left", F.col("budget") - F.col("pass") * F.col("tokens"))
        .withColumn("before", F.sum("size").over(ranked) - F.col("size"))
        .withColumn("place", F.row_number().over(ranked) - 1)
        .filter("before < left")
        .select(
            F.col("source").alias("_s"), F.col("block").alias("_b"), F.struct("pass", "place", "before", "left").alias("draw")
        )
    )
    lots = passes.groupBy("_s", "_b").agg(F.collect_list("draw").alias("_draws"))

    row = F.struct(*[col(c) for c in keyed.columns])
    body = keyed.select(F.col(source).alias("_s"), F.col(tokens).alias("_t"), F.col(hashed).alias("_h"), row.alias("_row"))
    body = lookup_join(body, small.withColumnRenamed("source", "_s"), ["_s"], "docs", "inner").withColumn("_b", F.pmod("_h", "blocks"))
    ties = [F.col("_row")[id_col if keep else "doc_id"], F.col("_t")]
    within = Window.partitionBy("_s", "_b").orderBy("_h", *ties)
    placed = body.withColumn("_before", F.sum("_t").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).withColumn(
        "_slot", F.row_number().over(within) - 1
    )
    drawn = placed.join(lots, ["_s", "_b"]).select(
        "_row",
        "_s",
        "_t",
        "_slot",
        F.explode(F.filter("_draws", lambda d: d["before"] + F.col("_before") < d["left"])).alias("_draw"),
    )
    if keep:
        return drawn.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return drawn.select(
        F.col("_row")["doc_id"].alias("doc_id"),
        F.col("_s").alias("source"),
        F.col("_t").alias("n_tokens"),
        F.col("_draw")["pass"].cast("int").alias("pass"),
        F.col("_draw")["place"].cast("bigint").alias("block"),
        F.col("_slot").cast("bigint").alias("slot"),
    )
