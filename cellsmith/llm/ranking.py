"""Quality scores learned from preference pairs (Bradley-Terry)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsmith.llm.common import col
from cellsmith.operators.ordering import _exact
from cellsmith.session import checkpointed

#: Labelled rows that are paired with each other in one task, and the least of each kind among them.
BLOCK_ROWS, KIND_ROWS = 8_000, 64
#: Preferred documents that each other one is paired with.
RIVALS = 8
#: Score at which a document counts as good; the quantile of the fitted scores maps to it.
PASS = 0.7
SHAPES = 256
STATS = 6
WIDTH = 256 + SHAPES + STATS
#: Words whose bucket is remembered, and the longest that is.
CACHE_WORDS, CACHE_BYTES = 1 << 17, 192


class Featurizer:
    """Shares of bytes, shares of hashed word shapes, and a few ratios of a text. No label, id, source or language enters."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        """Bucket of a word's shape: classes of its characters, runs shortened to one, marks at the end kept."""
        shape, before = [], ""
        for c in word.decode(errors="replace"):
            kind = "9" if c.isdigit() else "x" if c.islower() else "X" if c.isupper() else c if c.isascii() else "u"
            if kind != before:
                shape.append(kind)
            before = kind
        b = crc32("".join(shape).encode()) % SHAPES
        if len(word) <= CACHE_BYTES:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = b
        return b

    def of(self, text: str) -> np.ndarray:
        data = text.encode()
        words = Counter(data.split())
        n = sum(words.values())
        out = np.zeros(WIDTH, dtype=np.float32)
        if not n:
            return out
        out[:256] = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / len(data)
        known = self.known
        buckets = [known[w] if w in known else self._bucket(w) for w in words]
        counts = np.fromiter(words.values(), dtype=np.float64, count=len(words))
        out[256 : 256 + SHAPES] = np.bincount(buckets, weights=counts, minlength=SHAPES) / n
        lines = [x for x in data.split(b"\n") if x.strip()]
        shares = counts / n
        out[-STATS:] = (
            log1p(n),
            len(words) / n,
            1 - len(set(lines)) / len(lines),
            len(data) / n / 10,
            float((shares * shares).sum()),
            log1p(n / len(lines)),
        )
        return out


@dataclass
class Ranker:
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    cut: float
    gain: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) / self.spread).clip(-8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def place(self, low: float, high: float, middle: float) -> None:
        """The cut between two neighbouring scores; ``middle`` is the median of those above it."""
        self.cut = (float(low) + float(high)) / 2
        self.gain = 4.0 / max(1e-6, float(middle) - self.cut)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and PASS exactly at the cut."""
        z = self.gain * (self.raw(x) - self.cut) + np.log(PASS / (1 - PASS))
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def fit_weights(z: np.ndarray, good: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 0.03) -> np.ndarray:
    """Logistic loss on differences of (preferred, other) pairs of scaled rows that hold both kinds."""
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    rnd = np.random.default_rng(11)
    left = up[np.concatenate([rnd.integers(0, len(up), len(down) * RIVALS), np.arange(len(up))])]
    right = down[np.concatenate([np.repeat(np.arange(len(down)), RIVALS), rnd.integers(0, len(down), len(up))])]
    w = np.zeros(z.shape[1], dtype=np.float32)
    seen = np.zeros_like(w)
    for _ in range(steps):
        s = z @ w
        lost = 1 / (1 + np.exp((s[left] - s[right]).clip(-30, 30)))
        pull = np.bincount(left, lost, len(z)) - np.bincount(right, lost, len(z))
        g = pull.astype(np.float32) @ z / len(left) - decay * w
        seen += g * g
        w += rate * g / (np.sqrt(seen) + 1e-8)
    return w


def fit_pairs(x: np.ndarray, good: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 0.03) -> Ranker | None:
    """The model of rows at hand; None if one of both kinds is missing.

    The cut is the quantile of all fitted scores at the share of documents that are not good.
    """
    if not good.any() or good.all():
        return None
    model = Ranker(np.zeros(x.shape[1], dtype=np.float32), x.mean(axis=0), x.std(axis=0) + 1e-3, 0.0, 1.0)
    model.weights = fit_weights(model.scaled(x).astype(np.float32), good, steps, rate, decay)
    scores = np.sort(model.raw(x))
    below = int((~good).sum())
    model.place(scores[below - 1], scores[below], np.median(scores[below:]))
    return model


def _unpacked(x: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(decompress(v.as_py()), dtype=np.float32) for v in x])


def _scaling(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature; tasks hand on one sum, which Spark adds up by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * WIDTH)
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column("x")).astype(np.float64)
                total += np.concatenate([x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * WIDTH)), pa.array(total)], names=["at", "v"])

    sums = rows.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    mean, square = np.array([r["v"] for r in sorted(sums, key=lambda r: r["at"])]).reshape(2, WIDTH) / n
    return mean.astype(np.float32), (np.sqrt(np.maximum(square - mean * mean, 0.0)) + 1e-3).astype(np.float32)


def _weights(rows: DataFrame, good: int, bad: int, model: Ranker) -> np.ndarray:
    """Mean of the blocks' weights by their rows.

    Every row is dealt to a block by the hash of its id. Rows of a scarce kind are dealt to as many blocks as it takes
    to give each about KIND_ROWS of them, so no block lacks a rival and all rows are fitted.
    """
    blocks = -(-(good + bad) // BLOCK_ROWS)
    often = lambda n: F.lit(min(blocks, -(-KIND_ROWS * blocks // n)) - 1)
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("good"), often(good)).otherwise(often(bad))))
    dealt = rows.select("id", "good", "x", copy.alias("copy"))
    dealt = dealt.select("id", "good", "x", F.pmod(F.xxhash64("id") + F.col("copy"), F.lit(blocks)).alias("block"))

    def fit(block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        kinds = block.column("good").to_numpy(zero_copy_only=False).astype(bool)
        if not kinds.any() or kinds.all():
            return pa.table({"n": pa.array([], pa.int64()), "w": pa.array([], pa.list_(pa.float64()))})
        w = fit_weights(model.scaled(_unpacked(block.column("x"))).astype(np.float32), kinds)
        return pa.table({"n": [len(kinds)], "w": [w.astype(np.float64)]})

    fitted = dealt.groupBy("block").applyInArrow(fit, "n bigint, w array<double>")
    sums = fitted.select("n", F.posexplode("w").alias("at", "w")).groupBy("at").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w"))
    return np.array([r["w"] for r in sorted(sums.collect(), key=lambda r: r["at"])], dtype=np.float32)


def _cut(rows: DataFrame, good: int, bad: int, model: Ranker) -> Ranker:
    """The model with its cut at the share of rows that are not good, among the scores of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.raw(_unpacked(batch.column("x"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(scores.astype(np.float64))], names=["v"])

    scores = checkpointed(rows.select("x").mapInArrow(run, "v double"))
    middle = [bad + (good - 1) // 2, bad + good // 2]
    at = _exact(scores, sorted({bad - 1, bad, *middle}))
    model.place(at[bad - 1], at[bad], (at[middle[0]] + at[middle[1]]) / 2)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranker | None:
    """The model of every labelled row outside the held-out fold; None if one of both kinds is missing.

    Pairs are fitted in blocks of about BLOCK_ROWS rows, from one scaling for all, and the weights are averaged; the cut
    comes from the scores of all rows. Only sums, weights and quantiles reach the driver. Repeated labels of an id are
    averaged, of repeated texts of an id one is used; NULL ids and labels are not used.
    """
    known = labels.select(col(id_col).cast("bigint").alias("id"), col(label_col).alias("label")).filter("id is not null and label is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg((F.avg("label") >= 0.5).alias("good"))
    texts = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).cast("string").alias("text"))
    texts = texts.filter(F.col("id").isNotNull() & ~held_out(F.col("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Featurizer()
        for batch in batches:
            x = [compress(maker.of(t.as_py() or "").tobytes(), 1) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, pa.binary())], names=["id", "x"])

    # Features are a fraction of the texts, so they are what is shuffled to meet the labels.
    made = texts.mapInArrow(run, "id bigint, x binary").groupBy("id").agg(F.min("x").alias("x"))
    rows = checkpointed(made.hint("merge").join(known, "id").select("id", "good", "x"))
    n, good = rows.agg(F.count("*"), F.count_if("good")).first()
    if not 0 < good < n:
        return None
    model = Ranker(np.zeros(WIDTH, dtype=np.float32), *_scaling(rows, n), 0.0, 1.0)
    model.weights = _weights(rows, good, n - good, model)
    return _cut(rows, good, n - good, model)


def held_out(doc_id):
    """Fixed by the query contract: the fold that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    NULL text is empty and scored as such. Without a model (no labels of both kinds)
    every score is 0.5. NULL ids are not held out, repeated rows are scored each, an
    empty table gives an empty result, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, ranker = Featurizer(), shared.value
        for batch in batches:
            n = batch.num_rows
            if ranker is None or not n:
                scores = np.full(n, 0.5)
            else:
                scores = ranker.score(np.stack([maker.of(t.as_py() or "") for t in batch.column("text")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores.astype(np.float64))], names=["doc_id", "score"])

    picked = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("string").alias("text"))
    scored = picked.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PASS).cast("int").alias("predicted"))
