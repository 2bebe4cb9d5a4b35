"""Exact duplicates by owners at the ends of compressed radix tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import col, fresh, text_of
from cellsmith.operators.lookup import lookup_join
from cellsmith.session import checkpointed

#: Bytes of labels that a task's trie holds, what a node counts beside its label, and bytes of text in a batch that goes out.
TRIE_BYTES, NODE_BYTES, BATCH_BYTES = 32 << 20, 400, 4 << 20
KEY = ["n_bytes", "digest"]


class Owner:
    """The id that stays, the rows that have this id, all rows, and the digest of the text."""

    __slots__ = ("digest", "id", "rows", "top")

    def __init__(self, id: int | None, top: int, rows: int, digest: str):
        self.id, self.top, self.rows, self.digest = id, top, rows, digest

    def join(self, other: Owner, largest: bool) -> None:
        self.rows += other.rows
        if self.id == other.id:
            self.top += other.top
        elif self.id is None or (other.id is not None and (other.id > self.id) == largest):
            self.id, self.top = other.id, other.top


class Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.owner, self.children = label, owner, {}


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, which is at least one byte."""
    low, high = 1, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie over whole byte strings; a node that ends a string holds its owner."""

    def __init__(self, largest: bool = True):
        self.root, self.largest, self.held = Node(b""), largest, 0

    def insert(self, text: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += len(text) - at + NODE_BYTES
                at = len(text)
            elif text.startswith(child.label, at):
                at += len(child.label)
            else:
                common = _shared(child.label, text, at)
                upper = Node(child.label[:common])
                node.children[text[at]] = upper
                child.label = child.label[common:]
                upper.children[child.label[0]] = child
                self.held += NODE_BYTES
                child, at = upper, at + common
            node = child
        if node.owner is None:
            node.owner = owner
        else:
            node.owner.join(owner, self.largest)

    @staticmethod
    def strings(top: Node, before: bytes) -> Iterator[tuple[bytes, Owner]]:
        """What ends in a subtree, in byte order; ``before`` leads to its top."""
        todo = [(top, before)]
        while todo:
            node, before = todo.pop()
            whole = before + node.label
            if node.owner is not None:
                yield whole, node.owner
            todo += [(node.children[b], whole) for b in sorted(node.children, reverse=True)]

    def _weights(self) -> dict[int, int]:
        """Bytes held under each node, by its identity."""
        weight, order, todo = {}, [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children.values()
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE_BYTES + sum(weight[id(c)] for c in node.children.values())
        return weight

    def spill(self, most: int) -> Iterator[tuple[bytes, Owner]]:
        """Give out and forget subtrees, the heaviest first, until at most ``most`` bytes are held.

        Below a node that alone holds more than is to go, its children are chosen among.
        """
        weight = self._weights()
        top, path = self.root, b""
        while self.held > most and top.children:
            byte, heavy = max(top.children.items(), key=lambda c: weight[id(c[1])])
            if weight[id(heavy)] > self.held - most and len(heavy.children) > 1:
                top, path = heavy, path + heavy.label
                continue
            yield from self.strings(heavy, path)
            del top.children[byte]
            self.held -= weight[id(heavy)]
        if top is not self.root and not top.children:
            # Emptied on the way down: what is left are ends on the path; a new start costs least.
            yield from self.clear()

    def clear(self) -> Iterator[tuple[bytes, Owner]]:
        yield from self.strings(self.root, b"")
        self.root, self.held = Node(b""), 0


def _batches(found: Iterator[tuple], schema: pa.Schema, text_at: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES of text."""
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += 200 + len(row[text_at] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_PARTIAL = pa.schema([("n_bytes", pa.int64()), ("digest", pa.string()), ("text", pa.binary()), ("owner", pa.int64()), ("top", pa.int64()), ("size", pa.int64())])
_OWNED = pa.schema([*_PARTIAL, ("variant", pa.int32())])
_PARTIAL_SQL = "n_bytes bigint, digest string, text binary, owner bigint, top bigint, size bigint"


def sha256(text: Column) -> Column:
    """Lower-case hex of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def owners(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, digest: Callable[[Column], Column] = sha256, held: int = TRIE_BYTES
) -> DataFrame:
    """(n_bytes, digest, variant, owner, top, size, text) of every distinct text: the id that stays, the rows that have
    it, and all rows.

    A task inserts its whole texts into one trie, so copies merge before the shuffle; beyond ``held`` bytes it spills subtrees as
    partial rows. Those meet by length and content hash, where a trie over whole byte strings settles each such key, one
    at a time. Only where different texts share a key do they get a ``variant`` above 0 and their ``text``.
    """

    def insert_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def partial():
            trie = Trie(largest)
            for batch in batches:
                for name, text, hashed in zip(*(c.to_pylist() for c in batch.columns)):
                    trie.insert(text, Owner(name, 1, 1, hashed))
                    if trie.held > held:
                        yield from trie.spill(held // 2)
            yield from trie.clear()

        rows = ((len(text), o.digest, text, o.id, o.top, o.rows) for text, o in partial())
        yield from _batches(rows, _PARTIAL, 2)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(trie: Trie, key: tuple):
            ends = list(trie.clear())
            for i, (text, o) in enumerate(ends):
                yield (*key, text if len(ends) > 1 else None, o.id, o.top, o.rows, i)

        def classes():
            trie, now = Trie(largest), None
            for batch in batches:
                for n_bytes, hashed, text, name, top, size in zip(*(c.to_pylist() for c in batch.columns)):
                    if now != (n_bytes, hashed):
                        if now:
                            yield from settled(trie, now)
                        now = n_bytes, hashed
                    trie.insert(text, Owner(name, top, size, hashed))
            if now:
                yield from settled(trie, now)

        yield from _batches(classes(), _OWNED, 2)

    text = text_of(text_col)
    picked = docs.select(col(id_col).cast("bigint").alias("id"), text.cast("binary").alias("text"), digest(text).alias("digest"))
    dealt = picked.mapInArrow(insert_all, _PARTIAL_SQL).repartition(*map(F.col, KEY)).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(settle, _PARTIAL_SQL + ", variant int")


def _one_row_each(rows: DataFrame, stays: str, key: list[str]) -> DataFrame:
    """Of the rows marked ``stays`` only one for each key: the first by a number that is written down with the rows."""
    tag = fresh(rows.columns, "tag")
    tagged = checkpointed(rows.withColumn(tag, F.when(col(stays), F.monotonically_increasing_id())))
    first = tagged.filter(col(stays)).groupBy(*key).agg(F.min(tag).alias("_first"), F.count("*").alias("_weight"))
    joined = lookup_join(tagged, first, key, "_weight")
    return joined.withColumn(stays, F.coalesce(col(stays) & (col(tag) == F.col("_first")), F.lit(False))).drop(tag, "_first")


def mark_duplicates(
    rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, digest: Callable[[Column], Column] = sha256, carry: list[str] | None = None
) -> DataFrame:
    """The columns ``carry`` (all but the text unless given), with ``keep_id``, ``group_size``, ``kept`` and ``text_digest``.

    Of equal texts the row with the largest id stays (``largest=False``: the smallest). NULL text is empty, and equal to it. NULL ids
    lose to all others; if several rows of a text share the id that stays, exactly one of them stays. An empty table gives an
    empty result. A result whose name the table has already gets a free one. A group of copies may hold a third of all rows:
    its copies merge in each task, and its owner reaches them by a lookup whose hot keys are broadcast.
    """
    carry = [c for c in rows.columns if c != text_col] if carry is None else carry
    keep_id, group_size, kept, text_digest = (fresh(carry, n) for n in ("keep_id", "group_size", "kept", "text_digest"))
    found = checkpointed(owners(rows, id_col, text_col, largest, digest))
    text = text_of(text_col)
    taken = [*carry, keep_id, group_size, kept, text_digest]
    names = {n: fresh(taken, f"_{n}") for n in ("n_bytes", "digest", "id", "owner", "top", "size", "variant", "weight", "text")}
    key = [names["n_bytes"], names["digest"]]
    keyed = [F.octet_length(text).cast("bigint").alias(key[0]), digest(text).alias(key[1]), col(id_col).cast("bigint").alias(names["id"])]
    about = [F.col(n).alias(names[n]) for n in ("n_bytes", "digest", "owner", "top", "size", "variant")] + [F.col("size").alias(names["weight"])]

    def joined(part: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
        return lookup_join(part, lookup, on, names["weight"])

    narrow = rows.select(*[col(c) for c in carry], *keyed)
    if found.filter("text IS NOT NULL").isEmpty():
        # No two texts share length and hash, so the key names the text; a text of one row is its own owner.
        made = joined(narrow, found.filter("size > 1").select(*about), key)
    else:
        whole = narrow.columns
        told = rows.select(*[col(c) for c in carry], *keyed, text.cast("binary").alias(names["text"]))
        clashing = found.filter("text IS NOT NULL").select(*about, F.col("text").alias(names["text"]))
        keys = clashing.select(*key, F.lit(True).alias(names["variant"]), F.lit(1).alias(names["weight"])).distinct()
        split = joined(told, keys, key)
        clear = split.filter(col(names["variant"]).isNull()).select(*map(col, whole))
        clear = joined(clear, found.filter("text IS NULL AND size > 1").select(*about), key)
        unclear = split.filter(col(names["variant"]).isNotNull()).select(*map(col, [*whole, names["text"]]))
        unclear = joined(unclear, clashing, [*key, names["text"]]).drop(names["text"])
        made = clear.unionByName(unclear)
    alone = col(names["size"]).isNull()
    made = made.withColumns(
        {
            keep_id: F.when(alone, col(names["id"])).otherwise(col(names["owner"])),
            group_size: F.coalesce(col(names["size"]), F.lit(1)).cast("bigint"),
            kept: alone | col(names["id"]).eqNullSafe(col(names["owner"])),
            text_digest: col(key[1]),
        }
    )
    if not found.filter("top > 1").isEmpty():
        variant = names["variant"]
        made = made.withColumn(variant, F.coalesce(col(variant), F.lit(0)))
        several = col(kept) & (F.coalesce(col(names["top"]), F.lit(1)) > 1)
        rest = made.filter(~several)
        made = rest.unionByName(_one_row_each(made.filter(several), kept, [*key, variant]))
    return made.select(*map(col, taken))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """``docs`` with one row of each text; rules as in ``mark_duplicates``."""
    marked = mark_duplicates(docs, id_col, text_col, largest, carry=docs.columns)
    return marked.filter(col(fresh(docs.columns, "kept"))).select(*[col(c) for c in docs.columns])
