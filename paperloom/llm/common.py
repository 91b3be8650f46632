"""Helpers that several operators share: work folders, Arrow batches, word splitting."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from paperloom.workspace import BATCH_ROWS, bound_batches, stored, work_dir

__all__ = ["BATCH_ROWS", "any_names", "bound_batches", "decoded", "map_batches", "map_rows", "place_of", "quoted", "stored", "text_bytes", "unused", "words_of", "work_dir"]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column; where none has just that name, of the first that differs in case only, as Spark finds it."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def any_names(*used: str) -> Callable:
    """For a function that keeps some of docs' rows, with all their columns in order: it gets docs with the columns that it uses under
    just these names and all others under unused ones, so that names which differ in case only can't be taken for each other. Its result has docs' names again."""

    def wrap(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            names = docs.columns
            own = {place_of(docs, c): c for c in used if c in {n.lower() for n in names}}
            return fn(docs.toDF(*[own.get(i, f"_other {i}") for i in range(len(names))]), *args, **more).toDF(*names)

        return run

    return wrap


def quoted(name: str) -> str:
    """A column name with dots, spaces or back quotes, as an expression."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for columns of any names: they are numbered for it (c0, c1, ...), in and out, and named by schema after it."""
    bound_batches(df.sparkSession)
    numbered = lambda fields: [f"c{i}" for i in range(len(fields))]
    types = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(numbered(schema.fields), schema.fields, strict=True)])
    return df.toDF(*numbered(df.columns)).mapInArrow(run, types).toDF(*schema.names)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch of df; fn may return None for no rows."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(name: str = "text"):
    """The column's UTF-8 bytes; Python gets bytes, so that malformed text can't stop a batch."""
    return F.col(name).cast("string").cast("binary").alias(name)


def decoded(raw: bytes | None) -> str:
    """Text of UTF-8 bytes; malformed bytes become U+FFFD, null an empty text."""
    return "" if raw is None else raw.decode("utf-8", "replace")


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at these six bytes only."""
    return raw.split()
