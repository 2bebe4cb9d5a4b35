"""Chained imputation (Bayesian ridge, random forest) and the blend of observed and generated cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsmith.functions.scalars import name, number_or_null
from cellsmith.session import checkpointed
from cellsmith.sources.tables import load_state, save_state

#: Missing patterns that a task maps at a time.
PATTERNS = 256
#: Rows of a partition that forests are fitted on.
PART_ROWS = 1 << 16
#: Bins of a column, rows that their edges are placed by (both as Spark's forests have them), and trees grown at a time.
BINS, EDGE_ROWS, GROWN_TOGETHER = 32, 10_000, 5
#: Up to so many possible cells, every cell is predicted once and handed to the tasks.
GRID_CELLS = 1 << 16


class NotFittedError(RuntimeError):
    pass


def blend(observed: DataFrame, generated: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Observed cells stay; missing cells take the generated value."""
    new = generated.select(name(key), *[name(c).alias(f"_g_{c}") for c in columns])
    joined = observed.join(new, key, "left")
    return joined.select(
        *[F.coalesce(number_or_null(name(c)), name(f"_g_{c}")).alias(c) if c in columns else name(c) for c in observed.columns]
    )


def sample_order(key: str, seed: int) -> Column:
    """Repeatable 52-bit position of a row in the seeded order."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), name(key).cast("string")))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("bigint").cast("double")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows first in the seeded order (all, if fewer); a threshold cut, so nothing is sorted or gathered.

    A first threshold keeps slightly more than n rows in one scan; the exact cut is found among those.
    """
    from cellsmith.operators.ordering import _exact

    order = sample_order(key, seed)
    total = df.count()
    if n >= total:
        return df
    near = n * 1.2 + 6.0 * n**0.5 + 64.0
    if near < total / 2:
        few = checkpointed(df.filter(order < F.lit(near / total * (1 << 52))))
        if few.count() >= n:
            df = few
    cut = _exact(df.select(order.alias("v")), [n - 1])[n - 1]
    return df.filter(order <= F.lit(cut))


def batch_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """One random mini-batch."""
    return seeded_sample(df, key, size, seed)


def bayesian_ridge(gram: np.ndarray, cross: np.ndarray, square: float, n: float, rounds: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Evidence-maximising ridge weights from centred sufficient statistics X'X, X'y, y'y."""
    tiny = 1e-6
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ cross
    noise, weight = 1.0 / (square / max(n, 1.0) + np.finfo(float).eps), 1.0
    old = None
    coef = np.zeros(len(cross))
    for _ in range(rounds):
        coef = vectors @ (rotated / (values + weight / noise))
        rest = max(square - 2 * coef @ cross + coef @ gram @ coef, 0.0)
        used = float(np.sum(noise * values / (weight + noise * values)))
        weight = (used + 2 * tiny) / (float(coef @ coef) + 2 * tiny)
        noise = (n - used + 2 * tiny) / (rest + 2 * tiny)
        if old is not None and np.abs(old - coef).sum() < tol:
            break
        old = coef
    return coef


def _replay(seen: np.ndarray, chain: list[tuple[int, float, list[float]]]) -> np.ndarray:
    """Maps (1, observed cells) -> imputed cells in centred units, one for each missing pattern (rows of ``seen``)."""
    patterns, d = seen.shape
    maps = np.zeros((patterns, d, d + 1))
    maps[:, np.arange(d), np.arange(d) + 1] = seen
    lacking = [np.flatnonzero(~seen[:, i]) for i in range(d)]
    for target, intercept, coef in chain:
        at = lacking[target]
        maps[at, target] = np.einsum("i,pij->pj", np.asarray(coef), maps[at])
        maps[at, target, 0] += intercept
    return maps


class ChainedRidge:
    """Chained equations with Bayesian ridge: mean start, fewest gaps first.

    An imputed cell is a linear function of the observed cells of its row, fixed by
    the row's missing pattern. So one pass over the table collects, per pattern,
    the sums of products of observed cells; every regression of every round then
    follows from those sums exactly, without touching the rows again.
    """

    def __init__(self, columns: Sequence[str], max_iter: int = 10, tol: float = 1e-3):
        self.columns, self.max_iter, self.tol = list(columns), max_iter, tol
        self.state: dict | None = None

    def _patterns(self, df: DataFrame, means: list[float], scales: list[float]) -> DataFrame:
        """(pattern, moment): per missing pattern the upper triangle of the sums of products of (1, observed cells)."""
        d = len(self.columns)
        cells = [number_or_null(name(c)) for c in self.columns]
        pattern = F.concat(*[c.isNotNull().cast("int").cast("string") for c in cells])
        z = [F.coalesce((c - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(cells, means, scales)]
        flat = df.select(pattern.alias("pattern"), *[v.alias(f"z{i}") for i, v in enumerate(z)])
        ones = [F.count("*").cast("double"), *[F.sum(f"z{i}") for i in range(d)]]
        products = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(d) for j in range(i, d)]
        return flat.groupBy("pattern").agg(F.array(*ones, *products).alias("moment"))

    def _gather(self, stats: DataFrame, chain: list, earlier: list, target: int) -> tuple[np.ndarray, np.ndarray]:
        """Moments of imputed rows that observe the target, and the squared change of each column against an earlier chain.

        Tasks map their patterns as one stack of matrices and hand on a single sum, which Spark adds up by position.
        """
        d = len(self.columns)
        upper = np.triu_indices(d + 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((d + 1) ** 2 + d)
            for pdf in batches:
                for start in range(0, len(pdf), PATTERNS):
                    part = pdf.iloc[start : start + PATTERNS]
                    seen = np.array([[bit == "1" for bit in p] for p in part["pattern"]])
                    moments = np.zeros((len(part), d + 1, d + 1))
                    moments[:, upper[0], upper[1]] = np.stack(part["moment"].to_numpy())
                    moments[:, upper[1], upper[0]] = moments[:, upper[0], upper[1]]
                    maps = _replay(seen, chain)
                    first = np.broadcast_to(np.eye(1, d + 1), (len(part), 1, d + 1))
                    full = np.concatenate([first, maps], axis=1)[seen[:, target]]
                    total[: (d + 1) ** 2] += (full @ moments[seen[:, target]] @ full.transpose(0, 2, 1)).sum(0).ravel()
                    move = maps - _replay(seen, earlier)
                    total[(d + 1) ** 2 :] += np.einsum("pij,pjk,pik->i", move, moments, move)
            yield pd.DataFrame({"v": [total]})

        parts = stats.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("at", "v"))
        flat = np.zeros((d + 1) ** 2 + d)
        for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
            flat[r["at"]] = r["v"]
        return flat[: (d + 1) ** 2].reshape(d + 1, d + 1), flat[(d + 1) ** 2 :]

    def fit(self, df: DataFrame) -> ChainedRidge:
        d = len(self.columns)
        cells = [number_or_null(name(c)) for c in self.columns]
        first = df.agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cells)],
            *[F.count(c).alias(f"k{i}") for i, c in enumerate(cells)],
            *[F.max(F.abs(c)).alias(f"a{i}") for i, c in enumerate(cells)],
        ).first()
        means = [first[f"m{i}"] or 0.0 for i in range(d)]
        scales = [first[f"s{i}"] or 1.0 for i in range(d)]
        gaps = sorted((first["n"] - first[f"k{i}"], i) for i in range(d))
        targets = [i for g, i in gaps if 0 < g < first["n"]]
        stats = checkpointed(self._patterns(df, means, scales))
        chain: list[tuple[int, float, list[float]]] = []
        most = max((first[f"a{i}"] or 0.0) for i in range(d)) if d else 0.0
        done = 0
        start: list = []
        for done in range(1, self.max_iter + 1 if targets else 1):
            begun = list(chain)
            stop = False
            for target in targets:
                moments, moved = self._gather(stats, chain, start, target)
                if target == targets[0] and done > 1:
                    # The first sums of a round also tell how far the round before it has moved each column.
                    stop = (np.sqrt(moved / first["n"]) * np.asarray(scales)).max() < self.tol * most
                    if stop:
                        break
                n = moments[0, 0]
                others = [i for i in range(d) if i != target]
                centre = moments[0, 1:] / n
                cov = moments[1:, 1:] - n * np.outer(centre, centre)
                coef = np.zeros(d)
                coef[others] = bayesian_ridge(cov[np.ix_(others, others)], cov[others, target], cov[target, target], n)
                chain.append((target, float(centre[target] - coef @ centre), coef.tolist()))
            if stop:
                done -= 1
                break
            start = begun
        self.state = {
            "kind": "chained_ridge",
            "columns": self.columns,
            "means": means,
            "scales": scales,
            "chain": chain,
            "rounds": done,
        }
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise NotFittedError("fit first")
        state = self.state
        means, scales = np.array(state["means"]), np.array(state["scales"])
        chain = [(int(t), float(i), list(c)) for t, i, c in state["chain"]]
        columns = self.columns

        @F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in columns]))
        def fill(*cells: pd.Series) -> pd.DataFrame:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cells])
            seen = ~np.isnan(x)
            z = np.where(seen, (x - means) / scales, 0.0)
            out = x.copy()
            kinds, which = np.unique(np.packbits(seen, axis=1), axis=0, return_inverse=True)
            which = which.reshape(-1)
            for kind in range(len(kinds)):
                rows = np.flatnonzero(which == kind)
                bits = seen[rows[0]]
                if bits.all():
                    continue
                a = _replay(bits[None], chain)[0]
                full = (a[:, 0] + z[rows] @ a[:, 1:].T) * scales + means
                out[rows] = np.where(seen[rows], x[rows], full)
            return pd.DataFrame(out, columns=columns)

        # Only the numbers go through Python; the other columns stay where they are.
        filled = df.withColumn("_filled", fill(*[name(c).cast("double") for c in columns]))
        return filled.select(*[F.col("_filled").getField(c).alias(c) if c in columns else name(c) for c in df.columns])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.state is None:
            raise NotFittedError("fit first")
        save_state(spark, self.state, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChainedRidge:
        state = load_state(spark, path)
        out = cls(state["columns"])
        out.state = state
        return out


def dealt_by_content(df: DataFrame, rows: int) -> DataFrame:
    """The same rows with ``_row``, a hash of row and copy number: what follows from it does not depend on the layout.

    Equal rows are counted first and then dealt by row and copy number, so that a hot row is spread; partitions are
    as many as the row count asks for.
    """
    columns = [name(c) for c in df.columns]
    copies = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    opened = copies.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    parts = max(8, -(-rows // PART_ROWS))
    return opened.withColumn("_row", F.xxhash64(*columns, "_copy")).drop("_copy").repartition(parts, "_row")


def poisson_draws(row: Column, trees: int, seed: int) -> Column:
    """How often each tree draws the row: Poisson with mean 1, fixed by the row's hash."""
    steps = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])

    def drawn(tree: Column) -> Column:
        unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, row), 11) / F.lit(float(1 << 53))
        return sum((unit >= F.lit(float(c))).cast("int") for c in steps)

    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)


def bin_edges(values: np.ndarray) -> list[float]:
    """Edges of at most BINS bins with about as many values each; every value has its own where they are few."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) < 2:
        return [-math.inf, float(found[0]) if len(found) else 0.0, math.inf]
    at = np.arange(len(found) - 1)
    if len(found) > BINS:
        at = np.unique(np.searchsorted(np.cumsum(counts), len(values) * np.arange(1, BINS) / BINS))
        at = at[at < len(found) - 1]
    middle = found[at] + (found[at + 1] - found[at]) / 2
    return [-math.inf, *np.unique(middle).tolist(), math.inf]


class ChainedForest:
    """Chained equations with random forests (10 trees, depth 10), mean start, fewest gaps first.

    A tree splits between bins only, so of the rows of a cell (the bins of all inputs) it needs how often it drew them and
    the mean of their targets: splits and leaves are those of the rows. One pass adds up the cells for all trees of a
    forest; the trees then grow on the cells. Every observed row is drawn for itself, by a hash of its content and
    copy number, so a table gives the same forests wherever and in whatever order its rows lie; NaN is NULL.
    """

    def __init__(self, columns: Sequence[str], max_iter: int = 5, trees: int = 10, depth: int = 10, tol: float = 1e-3, seed: int = 42):
        self.columns, self.max_iter, self.trees, self.depth, self.tol, self.seed = list(columns), max_iter, trees, depth, tol, seed
        self.means: list[float] | None = None
        #: (target, bin edges of the other columns, trees)
        self.steps: list[tuple[int, list[list[float]], list[RandomForestRegressionModel]]] = []

    def _start(self, df: DataFrame) -> DataFrame:
        gaps = [number_or_null(name(c)).isNull().alias(f"_m{i}") for i, c in enumerate(self.columns)]
        cells = [F.coalesce(number_or_null(name(c)), F.lit(m)).alias(f"_x{i}") for i, (c, m) in enumerate(zip(self.columns, self.means))]
        return df.select("*", *gaps, *cells)

    def _inputs(self, target: int) -> list[int]:
        return [i for i in range(len(self.columns)) if i != target]

    def _binned(self, df: DataFrame, target: int, edges: list[list[float]]) -> DataFrame:
        inputs = self._inputs(target)
        if not inputs:
            return df
        binned = Bucketizer(splitsArray=edges, inputCols=[f"_x{i}" for i in inputs], outputCols=[f"_b{i}" for i in inputs]).transform(df)
        # A sum has no metadata: bins are numbers in order here, not categories.
        return binned.withColumns({f"_b{i}": F.col(f"_b{i}") + F.lit(0.0) for i in inputs})

    def _assembled(self, df: DataFrame, target: int) -> DataFrame:
        return VectorAssembler(inputCols=[f"_b{i}" for i in self._inputs(target)], outputCol="_features").transform(df)

    def _predicted(self, df: DataFrame, target: int, models: list[RandomForestRegressionModel]) -> DataFrame:
        """Rows with bins get ``_pred``, the mean over the trees."""
        out = self._assembled(df, target)
        for t, model in enumerate(models):
            out = model.setPredictionCol(f"_p{t}").transform(out)
        mean = sum(F.col(f"_p{t}") for t in range(len(models))) / F.lit(float(len(models)))
        return out.select(*[name(c) for c in df.columns], mean.alias("_pred"))

    def _step(self, df: DataFrame, target: int, edges: list[list[float]], models: list[RandomForestRegressionModel]) -> DataFrame:
        """Fills the target. With few columns each possible cell is predicted once and looked up, else every row."""
        kept = [c for c in df.columns]
        inputs, bins = self._inputs(target), [len(e) - 1 for e in edges]
        binned = self._binned(df, target, edges)
        if math.prod(bins) <= GRID_CELLS:
            places = [math.prod(bins[at + 1 :]) for at in range(len(bins))]
            digits = [F.pmod(F.floor(F.col("id") / F.lit(p)), F.lit(n)).cast("double").alias(f"_b{i}") for i, p, n in zip(inputs, places, bins)]
            grid = df.sparkSession.range(math.prod(bins)).select(F.col("id").alias("_cell"), *digits)
            told = checkpointed(self._predicted(grid, target, models).select("_cell", "_pred"))
            cell = sum((F.col(f"_b{i}").cast("bigint") * F.lit(p) for i, p in zip(inputs, places)), F.lit(0).cast("bigint"))
            asked = binned.select(*[name(c) for c in kept], F.when(F.col(f"_m{target}"), cell).alias("_cell"))
            predicted = asked.join(F.broadcast(told), "_cell", "left")
        else:
            predicted = self._predicted(binned, target, models)
        new = F.when(F.col(f"_m{target}"), F.col("_pred")).otherwise(F.col(f"_x{target}"))
        return predicted.select(*[new.alias(c) if c == f"_x{target}" else name(c) for c in kept])

    def _edges(self, seen: DataFrame, target: int, rows: int) -> list[list[float]]:
        """Bins from a hash sample of about EDGE_ROWS rows, as forests place them; all rows are then counted in them."""
        inputs = [f"_x{i}" for i in self._inputs(target)]
        share = int(min(1.0, EDGE_ROWS / max(rows, 1)) * (1 << 30))
        few = seen.filter(F.pmod(F.xxhash64(F.lit(self.seed), F.lit("edges"), "_row"), F.lit(1 << 30)) < F.lit(share))
        found = few.select(*inputs).toPandas()
        return [bin_edges(found[c].to_numpy(dtype=float)) for c in inputs]

    def _grow(self, moving: DataFrame, target: int, rows: int) -> tuple[list[list[float]], list[RandomForestRegressionModel]]:
        seen = moving.filter(~F.col(f"_m{target}"))
        edges = self._edges(seen, target, rows)
        y = F.col(f"_x{target}")
        drawn = [F.col("_draws")[t] for t in range(self.trees)]
        sums = [c for t, w in enumerate(drawn) for c in (F.sum(w).cast("double").alias(f"w{t}"), F.sum(w * y).alias(f"s{t}"))]
        few_tasks = seen.coalesce(4 * seen.sparkSession.sparkContext.defaultParallelism)
        counted = self._binned(few_tasks, target, edges).groupBy(*[f"_b{i}" for i in self._inputs(target)])
        cells = self._assembled(counted.agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("s"), *sums), target)
        cells = checkpointed(cells.select("_features", "n", "s", *[f"{k}{t}" for t in range(self.trees) for k in "ws"]))
        total = cells.agg(*[F.sum(f"w{t}").alias(f"w{t}") for t in range(self.trees)]).first()

        def tree(t: int) -> RandomForestRegressionModel:
            # Of very few rows a tree may draw none; it then takes each once.
            w, s = (F.col(f"w{t}"), F.col(f"s{t}")) if total[f"w{t}"] else (F.col("n"), F.col("s"))
            own = cells.filter(w > 0).select("_features", w.alias("w"), (s / w).alias("y"))
            return RandomForestRegressor(
                numTrees=1,
                bootstrap=False,
                featureSubsetStrategy="onethird" if self.trees > 1 else "all",
                maxDepth=self.depth,
                maxBins=BINS,
                seed=self.seed + t,
                featuresCol="_features",
                labelCol="y",
                weightCol="w",
            ).fit(own)

        with ThreadPool(min(self.trees, GROWN_TOGETHER)) as pool:
            return edges, pool.map(inheritable_thread_target(moving.sparkSession)(tree), range(self.trees))

    def fit(self, df: DataFrame) -> ChainedForest:
        d = len(self.columns)
        cells = [number_or_null(name(c)) for c in self.columns]
        numbers = checkpointed(df.select(*[c.alias(f"_c{i}") for i, c in enumerate(cells)]))
        first = numbers.agg(
            F.count("*").alias("n"),
            *[F.avg(f"_c{i}").alias(f"m{i}") for i in range(d)],
            *[F.count(f"_c{i}").alias(f"k{i}") for i in range(d)],
            *[F.max(F.abs(f"_c{i}")).alias(f"a{i}") for i in range(d)],
        ).first()
        # Twelve digits: the order of a sum over partitions must not show.
        self.means = [float(f"{first[f'm{i}'] or 0.0:.12g}") for i in range(d)]
        self.steps = []
        targets = [i for g, i in sorted((first["n"] - first[f"k{i}"], i) for i in range(d)) if 0 < g < first["n"]]
        most = max((first[f"a{i}"] or 0.0) for i in range(d)) if d else 0.0
        dealt = dealt_by_content(numbers, first["n"])
        gaps = [F.col(f"_c{i}").isNull().alias(f"_m{i}") for i in range(d)]
        filled = [F.coalesce(f"_c{i}", F.lit(m)).alias(f"_x{i}") for i, m in enumerate(self.means)]
        draws = poisson_draws(F.col("_row"), self.trees, self.seed).cast("array<tinyint>").alias("_draws")
        current = checkpointed(dealt.select(*gaps, *filled, "_row", draws))
        for _ in range(self.max_iter):
            moving = current.select("*", *[F.col(f"_x{i}").alias(f"_o{i}") for i in range(d)])
            for target in targets:
                edges, models = self._grow(moving, target, first[f"k{target}"])
                self.steps.append((target, edges, models))
                moving = self._step(moving, target, edges, models)
            moving = checkpointed(moving)
            change = moving.agg(*[F.max(F.abs(F.col(f"_x{i}") - F.col(f"_o{i}"))).alias(f"c{i}") for i in range(d)]).first()
            current = moving.drop(*[f"_o{i}" for i in range(d)])
            if max((change[f"c{i}"] or 0.0) for i in range(d)) < self.tol * most:
                break
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.means is None:
            raise NotFittedError("fit first")
        out = self._start(df)
        for at, (target, edges, models) in enumerate(self.steps, 1):
            out = self._step(out, target, edges, models)
            if at % 8 == 0:
                out = checkpointed(out)
        spot = {c: i for i, c in enumerate(self.columns)}
        return out.select(*[F.col(f"_x{spot[c]}").alias(c) if c in spot else name(c) for c in df.columns])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.means is None:
            raise NotFittedError("fit first")
        for i, (_, _, models) in enumerate(self.steps):
            for t, model in enumerate(models):
                model.write().overwrite().save(f"{path}/model{i}_{t}")
        # The outer edges are no JSON numbers.
        steps = [{"target": target, "edges": [e[1:-1] for e in edges], "trees": len(models)} for target, edges, models in self.steps]
        save_state(spark, {"columns": self.columns, "means": self.means, "steps": steps}, f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChainedForest:
        state = load_state(spark, f"{path}/state")
        out = cls(state["columns"])
        out.means = state["means"]
        for i, step in enumerate(state["steps"]):
            models = [RandomForestRegressionModel.load(f"{path}/model{i}_{t}") for t in range(step["trees"])]
            out.steps.append((int(step["target"]), [[-math.inf, *e, math.inf] for e in step["edges"]], models))
        return out
