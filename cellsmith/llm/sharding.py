"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.llm.common import col, text_of
from cellsmith.session import checkpointed

#: Ranges of the text hash that are summed first, and by how many bits a range that a cut may fall into is looked into.
ATOMS, FINER_BITS = 1 << 16, 8
#: Rows that one task numbers at a time; a hot atom is split into as many parts as it needs.
PART_ROWS = 20_000
PART_SEEDS = 1 << 30


def _fits(ends: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Greedy check: first atom of each shard if ``shards`` contiguous runs of at most ``capacity`` hold all atoms."""
    cuts, done, first = [], 0, 0
    for _ in range(shards):
        cuts.append(first)
        first = int(np.searchsorted(ends, done + capacity, side="right"))
        if first == len(ends):
            return cuts + [first] * (shards - len(cuts))
        done = int(ends[first - 1]) if first else 0
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """First atom of each shard such that the largest shard is as small as it can be; empty shards come last."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    if not len(ends) or not ends[-1]:
        return [0] * shards
    low = max(int(np.max(sizes)), -(-int(ends[-1]) // shards))
    high = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if _fits(ends, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return _fits(ends, shards, low)


class Pieces:
    """Consecutive ranges of the text hash, in order: where each begins, its bytes, and whether it is a single group."""

    def __init__(self, bits: int, found: list):
        self.start = [r["prefix"] << (64 - bits) for r in found]
        self.bits = [bits] * len(found)
        self.size = [r["size"] for r in found]
        self.single = [r["single"] for r in found]

    def replace(self, finer: Pieces, at: set[int]) -> None:
        rest = [i for i in range(len(self.start)) if i not in at]
        rows = [(self.start[i], self.bits[i], self.size[i], self.single[i]) for i in rest]
        rows += zip(finer.start, finer.bits, finer.size, finer.single)
        self.start, self.bits, self.size, self.single = map(list, zip(*sorted(rows)))

    def unsure(self, shards: int) -> list[int]:
        """Pieces of several groups that a cut of the least capacity may fall into.

        That capacity lies between ``low``, which no partition can go below, and what cuts between pieces
        reach; a cut lies between those of a greedy run at ``low`` and the same share of the upper capacity.
        """
        ends = np.cumsum(np.array(self.size, dtype=np.int64))
        if not len(ends):
            return []
        begins = ends - self.size
        high = max(int(ends[b - 1] if b else 0) - int(ends[a - 1] if a else 0) for a, b in pairwise([*minimax_cuts(np.array(self.size), shards), len(ends)]))
        low = max(-(-int(ends[-1]) // shards), max((s for s, one in zip(self.size, self.single) if one), default=0))
        if low >= high:
            return []
        found: set[int] = set()
        near = far = 0
        for _ in range(shards):
            at = int(np.searchsorted(ends, near + low, side="right"))
            near = int(ends[at - 1]) if at else 0
            far += high
            first, last = int(np.searchsorted(ends, near, side="right")), int(np.searchsorted(begins, far, side="left"))
            found.update(i for i in range(first, last) if not self.single[i])
        return sorted(found)


def _cut_hashes(rows: DataFrame, shards: int, bits: int) -> list[int]:
    """Hash at which each shard but the first begins; the largest shard is as small as cuts between groups allow."""

    def pieces(df: DataFrame, bits: int) -> Pieces:
        prefix = F.shiftright("hash", 64 - bits)
        single = (F.min("hash") == F.max("hash")).alias("single")
        return Pieces(bits, df.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), single).orderBy("prefix").collect())

    known = pieces(rows, bits)
    while todo := known.unsure(shards):
        for depth in sorted({known.bits[i] for i in todo}):
            at = [i for i in known.unsure(shards) if known.bits[i] == depth]
            if not at:
                continue
            prefixes = rows.sparkSession.createDataFrame([(known.start[i] >> (64 - depth),) for i in at], "prefix bigint")
            inside = rows.withColumn("prefix", F.shiftright("hash", 64 - depth)).join(F.broadcast(prefixes), "prefix", "left_semi")
            known.replace(pieces(inside, min(64, depth + FINER_BITS)), set(at))
    cuts = minimax_cuts(np.array(known.size, dtype=np.int64), shards)
    return [known.start[c] if c < len(known.start) else None for c in cuts[1:]]


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", atoms: int = ATOMS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; size = UTF-8 bytes of the text plus 8.

    Equal texts form an atomic group (told apart by a 64-bit hash), ordered by that hash. Sizes are summed over ``atoms`` (a power of
    two) ranges of the hash, and only ranges that a cut may fall into are looked into more finely, until cuts lie
    between groups: the largest shard is minimal over all of them. The driver sees some 65,000 sums and 256 for each range looked into.
    Slots count from 0 without gaps inside each shard.

    NULL texts count as empty, NULL ids and repeated rows are placed as any row, an
    empty table gives an empty result, other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    bits = max(1, atoms.bit_length() - 1)
    text = text_of(text_col)
    rows = docs.select(
        col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.pmod(F.xxhash64(col(id_col), text), F.lit(PART_SEEDS)).cast("int").alias("seed"),
    )
    rows = checkpointed(rows)
    shard = F.lit(0)
    for cut in _cut_hashes(rows, shards, bits):
        if cut is not None:
            shard = shard + (F.col("hash") >= F.lit(cut)).cast("int")
    cut_rows = rows.withColumn("shard", shard).withColumn("atom", F.shiftright("hash", 64 - bits)).drop("hash")
    totals = cut_rows.groupBy("shard", "atom").agg(F.count("*").alias("rows")).orderBy("shard", "atom").collect()
    places, base, now = [], 0, None
    for r in totals:
        base, now = (0 if r["shard"] != now else base), r["shard"]
        places.append((r["atom"], r["shard"], base, -(-r["rows"] // PART_ROWS)))
        base += r["rows"]
    units = spark.createDataFrame(places, "atom bigint, shard int, base bigint, parts bigint")
    placed = cut_rows.join(F.broadcast(units), ["atom", "shard"]).withColumn("part", F.pmod(F.col("seed"), F.col("parts")))
    heads = (
        placed.groupBy("atom", "shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("skip", F.sum("n").over(Window.partitionBy("atom", "shard").orderBy("part")) - F.col("n"))
        .drop("n")
    )
    inner = Window.partitionBy("atom", "shard", "part").orderBy("seed", "doc_id", "text_crc32")
    return (
        placed.join(heads, ["atom", "shard", "part"])
        .withColumn("slot", F.col("base") + F.col("skip") + F.row_number().over(inner) - 1)
        .select("doc_id", "size", "text_crc32", "shard", "slot")
    )
