"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import col, fresh, slices

#: Fixed by the byte-level scheme: how a text is cut before the merges.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Entries of a generation of what a task remembers: pieces of at most CACHE_CHARS characters, and pairs of tokens.
CACHE_PIECES, CACHE_CHARS, CACHE_PAIRS = 1 << 17, 48, 1 << 17
FOREVER = 1 << 60
#: A pair of token ids is one number: left * SPAN + right.
SPAN = 1 << 24


def _byte_chars() -> dict[str, int]:
    """The scheme's printable stand-in for each byte: itself if printable, else the next free code from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """A bounded memory in two generations: when the young one is full it becomes the old one, and what is used again moves back."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def put(self, key, value):
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def again(self, key):
        """A value that is not among the young ones; None if it is forgotten."""
        value = self.old.get(key)
        return None if value is None else self.put(key, value)


class BytePairCoder:
    """Encodes and decodes with a byte-level tokenizer file in JSON form.

    For each prefix of a piece exactly one token can stand last in its encoding. An
    automaton lists the tokens that are suffixes of the prefix; the one that is
    compatible with the last token of the prefix before it is stored, and the stored
    tokens followed back from the end are the encoding.
    """

    def __init__(self, file: bytes):
        spec = json.loads(file)
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*ids.values(), *self.special.values()], default=0))
        for b, i in ids.items():
            self.bytes[i] = b
        self.length = [len(b) for b in self.bytes]
        self.whole = {b: i for b, i in ids.items() if b}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[int, int] = {}  # by left * SPAN + right
        made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(s) for s in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[ids[left] * SPAN + ids[right]] = rank
            made.setdefault(ids[left + right], (ids[left], ids[right], rank))
        self.made = made
        self.edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if len(b) == 1 or i in made:
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.whole = {b: i for b, i in self.whole.items() if len(b) == 1 or i in made}
        self.fits, self.known = Recent(CACHE_PAIRS), Recent(CACHE_PIECES)

    def forget(self) -> None:
        """Drop what encoding has remembered."""
        self.fits.forget()
        self.known.forget()
        self.edges.clear()

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(part, born, gone) of the parts on one edge of a token: the merge that makes each and the one that takes it up."""
        out = self.edges.get((token, side))
        if out is None:
            out, part, gone = [], token, FOREVER
            while part in self.made:
                born = self.made[part][2]
                out.append((part, born, gone))
                part, gone = self.made[part][side], born
            out.append((part, -1, gone))
            self.edges[token, side] = out
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together leaves the border between them.

        It does not if a pair of parts at the border merges while both exist. Among merges
        of one rank the leftmost comes first: the left part is then gone, the right one is not.
        """
        rank_of, right_parts = self.rank.get, self._edge(right, 0)
        for x, x_born, x_gone in self._edge(left, 1):
            for y, y_born, y_gone in right_parts:
                rank = rank_of(x * SPAN + y)
                if rank is not None and x_born < rank < x_gone and y_born < rank <= y_gone:
                    return False
        return True

    def piece_ids(self, piece: bytes) -> list[int]:
        token = self.whole.get(piece)
        if token is not None:  # as the walk below would find: the longest match at the end has nothing before it
            return [token]
        last, size, fits_of = [0] * (len(piece) + 1), self.length, self.fits
        done = 0
        recent = fits_of.young.get
        for end, token in self.automaton.iter(piece.decode("latin-1")):  # longest first at each end
            if end < done:
                continue
            before = end + 1 - size[token]
            if before:
                pair = last[before] * SPAN + token
                fits = recent(pair)
                if fits is None:
                    fits = fits_of.again(pair)
                    if fits is None:
                        fits = fits_of.put(pair, self.compatible(last[before], token))
                if not fits:
                    continue
            done = end + 1
            last[done] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def _packed(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit integers, of a piece that is not among the latest ones."""
        ids = self.known.again(piece)
        if ids is None:
            found = self.piece_ids(piece.encode())
            ids = pack(f"<{len(found)}I", *found)
            if len(piece) <= CACHE_CHARS:
                self.known.put(piece, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers. Strings of special tokens become those tokens."""
        out = []
        for part in self.split.split(text) if self.split else (text,):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif part:
                known, packed = self.known.young.get, self._packed
                out += [known(p) or packed(p) for p in PIECES.findall(part)]
        return b"".join(out)



def token_bytes(file: bytes) -> dict[int, bytes]:
    """Bytes of every token, special ones included."""
    coder = BytePairCoder(file)
    return {i: b for i, b in enumerate(coder.bytes) if b}


def decode(ids: list[int], table: dict[int, bytes] | list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", errors="replace")


_CODERS: dict[str, BytePairCoder] = {}


@contextmanager
def _coder(file: bytes) -> Iterator[BytePairCoder]:
    """One coder per worker and tokenizer; at the end of a task it forgets what it has remembered."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = BytePairCoder(file)
    try:
        yield _CODERS[key]
    finally:
        _CODERS[key].forget()
        pa.default_memory_pool().release_unused()


def _ids_of(packed: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """Numbers of ids, and the ids as lists."""
    sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a text has too many tokens for one row")
    flat = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
    return pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text.

    ``tokenizer``: path of the file on the driver; its content (about 2 MB) is broadcast.
    NULL text is empty, empty texts have no ids, NULL ids stay NULL, repeated rows are
    encoded each, an empty table gives an empty result, other columns are not read.
    A task remembers a bounded number of pieces, until its end.
    """
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(file.value) as coder:
            for batch in slices(batches, "text"):
                lists = _ids_of([coder.encode(t.as_py() or "") for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "n_tokens", "ids"])

    picked = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` but the ids, with the decoded text and the SHA-256 of the ids (little-endian, 32 bits).

    NULL ids decode as none. Column names for the results are made free of clashes.
    """
    with open(tokenizer, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in encoded.columns if c != ids_col]
    digest, text = fresh(others, "ids_sha256"), fresh(others, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(file.value) as coder:
            for batch in slices(batches, ids_col):
                digests, texts = [], []
                for value in batch.column(ids_col):
                    ids = np.asarray(value.values, dtype="<u4") if value.is_valid else np.empty(0, "<u4")
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    texts.append(decode(ids.tolist(), coder.bytes))
                made = [pa.array(digests, pa.string()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, digest, text])

    fields = [encoded.schema[c] for c in others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return encoded.mapInArrow(run, f"{schema}, `{digest}` string, `{text}` string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded): what ``decode_documents(encode_documents(docs))`` gives, in one pass, so that the
    ids never leave the task."""
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(file.value) as coder:
            for batch in slices(batches, "text"):
                packed = [coder.encode(t.as_py() or "") for t in batch.column("text")]
                sizes = pa.array([len(p) // 4 for p in packed], pa.int64())
                digests = pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string())
                texts = pa.array([decode(np.frombuffer(p, dtype="<u4").tolist(), coder.bytes) for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, digests, texts], names=["doc_id", "n_tokens", "ids_sha256", "decoded"])

    picked = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded string")
