"""A metric index held as tables: a tree of pivots that rows descend by joins.

Every node with more than LEAF_ROWS rows is split among at most FAN pivots, its rows
going to the nearest. A level is a table with one row per child: pivot, least
and greatest distance of the child's rows from it, and whether the child is
split again. The triangle inequality tells which children can hold something
within a radius of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from cellsmith.operators.lookup import lookup_join
from cellsmith.session import checkpointed

LEAF_ROWS, FAN = 2048, 256
#: Rows that a search of a level hands on at a time: a query may go to every child of its node.
SENT_ROWS = 8192
#: A level of at most this many bytes is handed to the tasks; a larger one meets its rows by shuffle.
LEVEL_BYTES = 32 << 20
#: Bytes of packed blocks that a task holds while the blocks of the other side pass by, and that a task packs.
HELD_BYTES, PACKED_BYTES = 96 << 20, 16 << 20
#: A child with nearly all rows of its node is not split again: its leaf is compared in a grid of blocks.
SHRINK = 0.9
SLACK = 1e-6
VECTOR = T.ArrayType(T.DoubleType())


def stack(series: pd.Series, dims: int) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(float) if len(series) else np.zeros((0, dims))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0)


def split_grid(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, rows: int = LEAF_ROWS):
    """Split both sides of every key into bounded pieces and pair each left piece with each right piece once."""
    left_counts = left.groupBy(*keys).agg(F.count("*").alias("_nl"))
    right_counts = right.groupBy(*keys).agg(F.count("*").alias("_nr"))
    sizes = left_counts.join(right_counts, keys).select(
        *keys,
        (F.col("_nl") + F.col("_nr")).alias("_n"),
        F.ceil(F.col("_nl") / F.lit(rows)).cast("int").alias("_ls"),
        F.ceil(F.col("_nr") / F.lit(rows)).cast("int").alias("_rs"),
    )
    sizes = checkpointed(sizes)

    def place(side: DataFrame, own: str, own_id: str, own_n: str, other: str, other_n: str, salt: int) -> DataFrame:
        piece = F.pmod(F.xxhash64(F.lit(salt), F.col(own_id)), F.col(own_n)).cast("int")
        return lookup_join(side, sizes, keys, "_n", "inner").select(
            *[F.col(c).alias(c) for c in side.columns], piece.alias(own), F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other)
        )

    grid = [*keys, "_lp", "_rp"]
    return (
        place(left, "_lp", left_id, "_ls", "_rp", "_rs", 1),
        place(right, "_rp", right_id, "_rs", "_lp", "_ls", 2),
        grid,
    )


@dataclass
class MetricIndex:
    """``leaves``: (space, node, iid, ivec); ``roots``: (space, rows, split); ``levels``: (space, node, child, vec, low, high, rows, split)."""

    leaves: DataFrame
    roots: DataFrame
    levels: list[DataFrame] = field(default_factory=list)
    dims: int = 0


def _meet(rows: DataFrame, level: DataFrame, row_id: str, dims: int, kernel: Callable, schema: T.StructType, piece: int = LEAF_ROWS) -> DataFrame:
    """``kernel(space, rows of a node, children of that node)`` for every node of a level: a frame, or frames one by one."""

    def frames(out) -> Iterable[pd.DataFrame]:
        return [out] if isinstance(out, pd.DataFrame) else out

    if level.count() * (8 * dims + 64) <= LEVEL_BYTES:
        children = {k: g.reset_index(drop=True) for k, g in level.toPandas().groupby(["space", "node"])}

        def near(batches):
            for pdf in batches:
                for key, part in pdf.groupby(["space", "node"], sort=False):
                    if key in children:
                        yield from frames(kernel(key[0], part, children[key]))

        return rows.mapInPandas(near, schema)
    left, right, grid = split_grid(rows, level, ["space", "node"], row_id, "child", piece)

    def block(key, part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = list(frames(kernel(key[0], part, own.sort_values("child").reset_index(drop=True)))) if len(part) and len(own) else []
        # A search may find nothing in a block.
        return pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema}, dtype=object)

    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(block, schema)


def _point_schema(name: str, id_type: T.DataType, *extra: tuple[str, T.DataType]) -> T.StructType:
    fields = [("space", T.LongType()), ("node", T.LongType()), (name, id_type), ("vec", VECTOR), *extra]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def build_index(points: DataFrame, dims: int, rows: int = LEAF_ROWS) -> MetricIndex:
    """Index of distinct vectors (space, iid, vec), a checkpointed table. Pivots are picked by hash, so equal input gives equal trees."""
    id_type = points.schema["iid"].dataType
    state = points.select("space", F.lit(0).cast("bigint").alias("node"), "iid", "vec")
    roots = checkpointed(state.groupBy("space").agg(F.count("*").alias("rows")).withColumn("split", F.col("rows") > rows))
    placed_schema = _point_schema("iid", id_type, ("away", T.DoubleType()))

    def nearest(space, part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x, pivots = stack(part["vec"], dims), stack(own["vec"], dims)
        child = squared(x, pivots).argmin(1)
        away = np.sqrt(((x - pivots[child]) ** 2).sum(1))
        return pd.DataFrame({"space": space, "node": own["child"].to_numpy()[child], "iid": part["iid"].to_numpy(), "vec": part["vec"].to_numpy(), "away": away})

    spaces = roots.filter("split").select("space", F.lit(0).cast("bigint").alias("node"), "rows")
    done, levels = [state], []
    active = state.join(spaces.select("space"), "space", "left_semi").select(state.columns) if not spaces.isEmpty() else None
    if active is not None:
        done = [state.join(spaces.select("space"), "space", "left_anti").select(state.columns)]
    while active is not None:
        depth = len(levels)
        turn = F.xxhash64(F.lit(depth), "vec")
        order = Window.partitionBy("space", "node").orderBy("_turn", "iid")
        # Hashes are even, so the first FAN of a node lie far below this cut: only those rows are ranked.
        cut = F.least(F.lit(1.0), F.lit(4.0 * FAN + 64.0) / F.col("_of")) * F.lit(2.0**64) - F.lit(2.0**63)
        sized = lookup_join(active, spaces.withColumn("_of", F.col("rows")), ["space", "node"], "rows", "inner")
        near = sized.withColumn("_turn", turn).filter(F.col("_turn") <= cut).drop("_of")
        first = near.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= FAN)
        wanted = F.col("_rn") <= F.ceil(F.col("rows") / rows)
        child = F.col("node") * FAN + F.col("_rn")
        pivots = checkpointed(first.join(spaces, ["space", "node"]).filter(wanted).select("space", "node", child.alias("child"), "vec", F.col("rows").alias("parent")))
        placed = checkpointed(_meet(active, pivots.drop("parent"), "iid", dims, nearest, placed_schema))
        stats = placed.groupBy("space", F.col("node").alias("child")).agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("rows"))
        again = (F.col("rows") > rows) & (F.col("rows") <= SHRINK * F.col("parent"))
        level = checkpointed(pivots.join(stats, ["space", "child"]).withColumn("split", again).drop("parent"))
        levels.append(level.select("space", "node", "child", "vec", "low", "high", "rows", "split"))
        spaces = level.filter("split").select("space", F.col("child").alias("node"), "rows")
        placed = placed.drop("away")
        if spaces.isEmpty():
            done.append(placed)
            break
        told = lookup_join(placed, level.select("space", F.col("child").alias("node"), "split", "rows"), ["space", "node"], "rows", "inner")
        done.append(told.filter(~F.col("split")).drop("split"))
        active = told.filter("split").drop("split")
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    return MetricIndex(leaves.select("space", "node", "iid", F.col("vec").alias("ivec")), roots, levels, dims)


def matrix(mat: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(mat).reshape(-1, dims)


@dataclass
class Blocks:
    """``table``: (space, node, piece, n, ids, mat, centre, reach, ...), a block a row; ``rows`` and ``dims`` of its vectors."""

    table: DataFrame
    rows: int
    dims: int


def packed(rows: DataFrame, dims: int, size: int, extra: Sequence[str] = (), bound: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, beside: Blocks | None = None) -> Blocks:
    """Rows (space, node, id, vec, *extra) of each leaf in blocks of about ``size``, checkpointed.

    A block is one row: its vectors as bytes, the other columns as arrays, and a ball (centre, reach) that holds all of them.
    ``bound`` gives a radius for each vector from the vectors of its own block, or of a block of its leaf in ``beside``; they become
    the array ``radius``, and ``most`` is the largest.
    """
    keys, at = ["space", "node"], ["space", "node", "piece"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_w")).withColumn("_pieces", F.ceil(F.col("_w") / F.lit(size)).cast("int"))
    sizes = checkpointed(sizes)
    blocks, count = (v or 0 for v in sizes.agg(F.sum("_pieces"), F.sum("_w")).first())
    piece = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("_pieces")).cast("int").alias("piece")
    placed = lookup_join(rows, sizes, keys, "_w", "inner").select(*keys, piece, "id", "vec", *extra)
    fields = {f.name: f.dataType for f in rows.schema}
    kinds = [("space", T.LongType()), ("node", T.LongType()), ("piece", T.IntegerType()), ("n", T.LongType()), ("ids", T.ArrayType(fields["id"])), ("mat", T.BinaryType()), ("centre", VECTOR), ("reach", T.DoubleType())]
    kinds += [(c, T.ArrayType(fields[c])) for c in extra] + ([("radius", VECTOR), ("most", T.DoubleType())] if bound else [])

    def listed(column: pa.ChunkedArray) -> pa.ListArray:
        values = column.combine_chunks()
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def numbers(values: np.ndarray) -> pa.ListArray:
        return listed(pa.chunked_array([pa.array(values, pa.float64())]))

    def pack(table: pa.Table, other: pa.Table | None = None) -> pa.Table:
        x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        centre = x.mean(axis=0)
        reach = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        if not np.isfinite(reach):
            centre, reach = np.zeros(dims), np.inf
        out = {k: table.column(k)[:1].combine_chunks() for k in at}
        out |= {"n": pa.array([len(x)]), "ids": listed(table.column("id")), "mat": pa.array([x.tobytes()], pa.binary()), "centre": numbers(centre), "reach": pa.array([reach])}
        out |= {c: listed(table.column(c)) for c in extra}
        if bound:
            radius = bound(x, x if other is None else matrix(other.column("_o_mat")[0].as_py(), dims))
            out |= {"radius": numbers(radius), "most": pa.array([float(radius.max())])}
        return pa.table(out)

    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-count * 8 * dims // PACKED_BYTES))
    grouped = placed.repartition(max(1, min(blocks, parts)), *at).groupBy(*at)
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    if beside is None:
        return Blocks(checkpointed(grouped.applyInArrow(lambda table: pack(table), schema)), count, dims)
    heads = beside.table.groupBy(*keys).agg(F.min("piece").alias("piece"))
    shown = beside.table.select(*at, "mat").join(heads, at).drop("piece")
    pieces = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("piece"))
    other = pieces.join(shown, keys).toDF(*(f"_o_{c}" for c in (*at, "mat"))).groupBy(*(f"_o_{c}" for c in at))

    def met(table: pa.Table, shown: pa.Table) -> pa.Table:
        # A piece of very few rows may have got none.
        return pack(table, shown) if len(table) else pa.table({n: pa.array([], to_arrow_type(t)) for n, t in kinds})

    return Blocks(checkpointed(grouped.cogroup(other).applyInArrow(met, schema)), count, dims)


def block_pairs(left: Blocks, right: Blocks, within: Column, also: Column | None = None) -> tuple[DataFrame, int]:
    """(l, r): blocks of both sides whose balls come within ``within`` of each other; and how many parts ``right`` is held in.

    The partitions of both sides meet without a shuffle, and nothing is written: a task holds a part of ``right``, about HELD_BYTES
    at most, and takes the blocks of one partition of ``left`` in turn, so the pairs of a left block in a task follow one another.
    """
    parts = max(1, -(-right.rows * 8 * right.dims // HELD_BYTES))
    one, other = left.table.select(F.struct("*").alias("l")), right.table.coalesce(parts).select(F.struct("*").alias("r"))
    gap = F.aggregate(F.zip_with("l.centre", "r.centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = F.sqrt(gap) * F.lit(1 - 1e-9) - F.lit(SLACK) - F.col("l.reach") - F.col("r.reach") <= within
    meets = (F.col("l.space") == F.col("r.space")) & near
    return one.join(other.hint("shuffle_replicate_nl"), meets if also is None else meets & also), parts


def _at_roots(index: MetricIndex, queries: DataFrame) -> DataFrame:
    at = lookup_join(queries, index.roots, ["space"], "rows", "inner")
    return at.withColumn("node", F.lit(0).cast("bigint"))


def _descend(index: MetricIndex, at: DataFrame, kernel: Callable, schema: T.StructType, piece: int = LEAF_ROWS) -> DataFrame:
    ended = [at.filter(~F.col("split"))]
    for level in index.levels:
        at = checkpointed(_meet(at.filter("split"), level, "qid", index.dims, kernel, schema, piece))
        ended.append(at.filter(~F.col("split")))
    out = ended[0].select([f.name for f in schema])
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.drop("split")


def home_leaf(index: MetricIndex, queries: DataFrame) -> DataFrame:
    """(space, node, qid, vec): each query at the leaf that the nearest pivots lead to."""
    dims = index.dims
    schema = _point_schema("qid", queries.schema["qid"].dataType, ("split", T.BooleanType()))

    def nearest(space, part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        child = squared(stack(part["vec"], dims), stack(own["vec"], dims)).argmin(1)
        return pd.DataFrame(
            {"space": space, "node": own["child"].to_numpy()[child], "qid": part["qid"].to_numpy(), "vec": part["vec"].to_numpy(), "split": own["split"].to_numpy()[child]}
        )

    return _descend(index, _at_roots(index, queries.select("space", "qid", "vec")), nearest, schema)


def _reached(space: int, part: pd.DataFrame, own: pd.DataFrame, dims: int) -> Iterator[pd.DataFrame]:
    """Queries at every child of their node that can hold a row within their radius, in frames of bounded size."""
    pivots, low, high = stack(own["vec"], dims), own["low"].to_numpy(), own["high"].to_numpy()
    child, split = own["child"].to_numpy(), own["split"].to_numpy()
    qid, vec = part["qid"].to_numpy(), part["vec"].to_numpy()
    radius = part["radius"].to_numpy(dtype=float)
    for start in range(0, len(part), 512):
        distance = np.sqrt(squared(stack(part["vec"].iloc[start : start + 512], dims), pivots))
        bound = radius[start : start + 512]
        bound = np.where(np.isnan(bound), np.inf, bound)
        least = np.maximum(distance - high[None, :], low[None, :] - distance)
        slack = SLACK * (1.0 + bound + distance.max(axis=1))
        row, col = np.nonzero(least <= (bound + slack)[:, None])
        row += start
        for sent in range(0, len(row), SENT_ROWS):
            r, c = row[sent : sent + SENT_ROWS], col[sent : sent + SENT_ROWS]
            yield pd.DataFrame({"space": space, "node": child[c], "qid": qid[r], "vec": vec[r], "radius": radius[r], "split": split[c]})


def leaves_within(index: MetricIndex, queries: DataFrame, radius: str | Column = "radius") -> DataFrame:
    """(space, node, qid, vec, radius): each query at every leaf that can hold a row within its radius (NULL: at all)."""
    dims = index.dims
    schema = _point_schema("qid", queries.schema["qid"].dataType, ("radius", T.DoubleType()), ("split", T.BooleanType()))

    def reach(space, part: pd.DataFrame, own: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return _reached(space, part, own, dims)

    asked = queries.select("space", "qid", "vec", (F.col(radius) if isinstance(radius, str) else radius).cast("double").alias("radius"))
    # A query may meet all FAN children of its node, so a block of a large level holds few queries.
    return _descend(index, _at_roots(index, asked), reach, schema, LEAF_ROWS // 4)
