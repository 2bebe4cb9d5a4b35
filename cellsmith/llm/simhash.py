"""Document fingerprints by weighted SimHash, and a search for all fingerprints within a Hamming radius."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellsmith.llm.common import col, text_of
from cellsmith.session import checkpointed

#: Width of a fingerprint, and the radius of the search: of different texts with a five-word Jaccard of at
#: least 0.8, more than nine in ten lie within 13 bits (a test measures it over all pairs of sf0.1), unlike ones hardly
#: ever below 28. In any two fingerprints at most RADIUS = 2 * BLOCKS - 1 bits apart, one of BLOCKS blocks
#: differs in one bit or none.
BITS, RADIUS, BLOCKS = 128, 13, 7
BLOCK_BITS = 20
CACHE_TERMS = 1 << 17


class Fingerprinter:
    """Words (without ASCII blanks) vote on bits by their hash, each with the square root of its count."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}

    def _hash(self, word: bytes) -> bytes:
        if len(self.known) >= CACHE_TERMS:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_128_digest(word)
        return h

    def of(self, text: bytes) -> bytes:
        """BITS / 8 bytes; a bit is set if the votes for it are more than those against. No words: all zero."""
        counts = Counter(text.split())
        if not counts:
            return bytes(BITS // 8)
        known, new = self.known.get, self._hash
        hashes = np.frombuffer(b"".join([known(w) or new(w) for w in counts]), dtype=np.uint8).reshape(-1, BITS // 8)
        weights = np.sqrt(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
        votes = 2 * (weights @ np.unpackbits(hashes, axis=1).astype(np.float32)) - weights.sum()
        return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down) gives way to the beginning of the following text."""
    tail = len(text) // 3
    return text[: len(text) - tail] + following[:tail]


PRINTED = "fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"


def _compare(maker: Fingerprinter, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following).encode()
    mark = maker.of(changed)
    return own.hex(), hashlib.sha256(changed).hexdigest(), mark.hex(), likeness(own, mark), likeness(own, next_print)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


_TYPES = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next) of every whole text.

    The following document is the next one by descending id (ties by the hash of the
    text, NULL ids last); after the last comes the first, and a single document follows
    itself. Texts are dealt once by ranges of the id and read in order; only the first
    and last text of each range wait for their neighbour in the next range.

    NULL text is empty; an empty text has the fingerprint of zeros. Repeated rows stay, an
    empty table gives an empty result, other columns are not read.
    """
    picked = docs.select(col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = picked.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    names = ["part", "doc_id", "n_chars", *(x.split()[0] for x in PRINTED.split(", ")), "first_text", "last_text"]
    types = [pa.int32(), pa.int64(), pa.int64(), *_TYPES, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, part = Fingerprinter(), TaskContext.get().partitionId()
        held: tuple[int | None, str, bytes] | None = None
        first: str | None = None
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = value.as_py()
                mark = maker.of(text.encode())
                if held is None:
                    first = text
                else:
                    out.append((part, held[0], len(held[1]), *_compare(maker, held[1], held[2], text, mark), first, None))
                    first = None
                held = doc_id, text, mark
            yield _table(out, names, types)
        if held is not None:
            yield _table([(part, held[0], len(held[1]), held[2].hex(), None, None, None, None, first, held[1])], names, types)

    made = checkpointed(ranged.mapInArrow(run, f"part int, doc_id bigint, n_chars bigint, {PRINTED}, first_text string, last_text string"))
    firsts = made.filter("first_text is not null").select("part", "first_text")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0))))
    turns = firsts.select("part", following.alias("next_part"))
    ends = made.filter("last_text is not null").select("part", "doc_id", "n_chars", "last_text")
    ends = ends.join(turns, "part").join(firsts.select(F.col("part").alias("next_part"), F.col("first_text").alias("following")), "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own, other = maker.of(r["last_text"].encode()), maker.of(r["following"].encode())
                rows.append((r["doc_id"], r["n_chars"], *_compare(maker, r["last_text"], own, r["following"], other)))
            yield _table(rows, names[1:-2], types[1:-2])

    last = ends.select("doc_id", "n_chars", "last_text", "following").mapInArrow(finish, f"doc_id bigint, n_chars bigint, {PRINTED}")
    return made.filter("last_text is null").select(*last.columns).unionByName(last)


def _halves(fingerprint: Column) -> list[Column]:
    """A fingerprint as two whole numbers of 64 bits."""
    number = lambda at: F.conv(F.substring(fingerprint, at, 8), 16, 10).cast("bigint")
    return [F.shiftleft(number(k), 32).bitwiseOR(number(k + 8)) for k in (1, 17)]


def _edges() -> list[tuple[int, int]]:
    """First bit and end of each block, counted from the low end of the fingerprint."""
    edges = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return list(zip(edges, edges[1:]))


def _blocks(high: Column, low: Column) -> list[Column]:
    """BLOCKS blocks of at most BLOCK_BITS neighbouring bits that cover the fingerprint; one may reach across both halves."""

    def bits(half: Column, a: int, b: int) -> Column:
        return F.shiftrightunsigned(half, a).bitwiseAND(F.lit((1 << (b - a)) - 1))

    out = []
    for a, b in _edges():
        if b <= 64:
            out.append(bits(low, a, b))
        elif a >= 64:
            out.append(bits(high, a - 64, b - 64))
        else:
            out.append(bits(low, a, 64).bitwiseOR(F.shiftleft(bits(high, 0, b - 64), 64 - a)))
    return out


def find_within(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(fingerprint, found, doc_id, n, apart): each fingerprint of ``prints`` within RADIUS bits of each one in ``queries``.

    Both have a column ``fingerprint``, ``prints`` also ``doc_id``. Equal fingerprints form
    one class first: ``found`` is its fingerprint, ``doc_id`` its smallest id (NULL if it has
    none), ``n`` its documents, and ``members`` lists them. A fingerprint is entered in one
    table per block; a query asks each table for its own block and for all that differ from
    it in one bit. A pair that meets in several tables stays in the first of them. Nothing
    is dropped: the tables together hold every pair within the radius.
    """

    def halves(df: DataFrame, side: str) -> DataFrame:
        return df.select("*", *[h.alias(f"{side}_{k}") for k, h in zip("hl", _halves(F.col("fingerprint")))])

    def keys(side: str, flipped: bool) -> Column:
        """The number of the table and the block in one whole number."""
        out = []
        for k, ((a, b), block) in enumerate(zip(_edges(), _blocks(F.col(f"{side}_h"), F.col(f"{side}_l")))):
            masks = [0, *(1 << bit for bit in range(b - a))] if flipped else [0]
            out += [block.bitwiseXOR(F.lit(k << BLOCK_BITS | m).cast("bigint")) for m in masks]
        return F.explode(F.array(*out))

    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    every = halves(classes, "d").withColumn("key", keys("d", False)).drop("fingerprint")
    asked = halves(queries.select("fingerprint").distinct(), "q").withColumn("key", keys("q", True))
    other = [F.col("d_h").bitwiseXOR(F.col("q_h")), F.col("d_l").bitwiseXOR(F.col("q_l"))]
    first = F.coalesce(*[F.when(F.bit_count(x) <= 1, F.lit(k)) for k, x in enumerate(_blocks(*other))])
    apart = F.bit_count(other[0]) + F.bit_count(other[1])
    table = F.shiftrightunsigned(asked["key"], BLOCK_BITS)
    # Both sides grow with the table, so neither is handed to every task.
    met = asked.join(every.hint("merge"), (asked["key"] == every["key"]) & (apart <= RADIUS) & (first == table))
    found = F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in ("d_h", "d_l")])
    return met.select("fingerprint", found.alias("found"), "doc_id", "n", apart.cast("int").alias("apart"))


def members(found: DataFrame, prints: DataFrame) -> DataFrame:
    """(fingerprint, doc_id): every document of ``prints`` that ``find_within`` found, one row each."""
    listed = prints.select(F.col("fingerprint").alias("found"), "doc_id")
    return found.select("fingerprint", "found").join(listed, "found").select("fingerprint", "doc_id")


def count_within(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """(fingerprint, n_within): documents of ``prints`` within RADIUS bits of each fingerprint in ``queries``, itself included."""
    named = prints.select("fingerprint", F.lit(None).cast("bigint").alias("doc_id"))
    return find_within(named, queries).groupBy("fingerprint").agg(F.sum("n").alias("n_within"))
