"""Small helpers that several corpus operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the query contracts: a word is a run of characters outside this class.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of a batch that are worked on at a time (a longer text alone).
SLICE_BYTES = 2 << 20


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that no table column uses, whatever its case."""
    used = {c.lower() for c in taken}
    name, n = base, 0
    while name.lower() in used:
        n += 1
        name = f"{base}_{n}"
    return name


def text_of(name: str = "text") -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array, in order."""
    return F.array_remove(F.split(text, BLANKS), "")


def md5_long(text: Column) -> Column:
    """60 bits of the MD5 digest as a whole number of at least zero; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rows_at_most(df: DataFrame, most: int) -> bool:
    """Counted, not estimated: whether the table is small enough to hand to every executor."""
    return df.limit(most + 1).count() <= most


def slices(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column ``sized`` (texts or ids) has about SLICE_BYTES in each."""
    for batch in batches:
        column = batch.column(sized)
        lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        upto = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
        for start, end in pairwise(cuts):
            if end > start:
                yield batch.slice(start, end - start)
