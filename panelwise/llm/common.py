"""Shared pieces of the corpus operators: Arrow columns as flat bytes, chunks of bounded size, null handling."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.session import new_path

#: Bytes of text that a task handles at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Names that the operators pass through as they are; the columns of ``documents``.
PLAIN_NAMES = frozenset({"doc_id", "text", "lang", "source", "n_chars"})


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets the caller's columns have any names, those of an operator's own working columns included.

    Columns other than those of ``PLAIN_NAMES`` go through under names of their own and get theirs back at the end. A
    carried column with the name of a new one is replaced by it.
    """
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        bound = signature.bind(docs, *args, **named)
        bound.apply_defaults()
        given = bound.arguments
        read = {name: given[name] for name in ("text", "by", "doc_id") if name in given}
        reads = [c for value in read.values() for c in ([value] if isinstance(value, str) else value)]
        carried = docs.columns if given["keep"] is None else given["keep"]
        odd = [c for c in dict.fromkeys([*carried, *reads]) if c.lower() not in PLAIN_NAMES]
        if not odd:
            return operator(*bound.args, **bound.kwargs)
        own = {c: f"carried_{i}" for i, c in enumerate(odd)}
        quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
        columns = [quoted(c).alias(own.get(c, c)) for c in dict.fromkeys([*carried, *reads])]
        for name, value in given.items():
            if isinstance(value, Column):
                columns.append(value.alias(f"given_{name}"))
                given[name] = F.col(f"given_{name}")
        for name, value in read.items():
            given[name] = own.get(value, value) if isinstance(value, str) else tuple(own.get(c, c) for c in value)
        given["keep"] = [own.get(c, c) for c in carried]
        given[next(iter(signature.parameters))] = docs.select(*columns)
        made = operator(*bound.args, **bound.kwargs)
        names = {new: c for c, new in own.items()}
        new = {c.lower() for c in made.columns if c not in names}
        return made.select(
            *[F.col(f"`{c}`").alias(names.get(c, c)) for c in made.columns if c not in names or names[c].lower() not in new]
        )

    return run


def utf8(text: str | Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b""))


def carries(docs: DataFrame, text: str | Column, carried: list[str]) -> bool:
    """Whether the text is a string column that is carried anyway, so that tasks need no second copy of it."""
    return isinstance(text, str) and text in carried and docs.schema[text].dataType.simpleString() == "string"


def rows(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose ``column`` holds at most ``limit`` bytes, or values of lists, or one row."""
    for batch in batches:
        ends = np.asarray(_offsets(batch.column(batch.schema.get_field_index(column))))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column in one array, and the borders of its values; nulls are empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    offsets = _offsets(array)
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def lists(values: np.ndarray, borders: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, kind))


def flat_lists(array: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column without nulls in one array, and the borders of its lists."""
    offsets = array.offsets.to_numpy().astype(np.int64)
    return array.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def places(borders: np.ndarray) -> np.ndarray:
    """The place of every value in its own list."""
    return np.arange(borders[-1]) - np.repeat(borders[:-1], np.diff(borders))


#: While a cut is written: shuffle files go as soon as its rows are there. Python gets batches of few rows, too.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def once(df: DataFrame, batch_rows: int = 1000) -> DataFrame:
    """A lineage cut that holds little disk and memory while it is written; the session's settings are put back.

    ``release`` deletes its rows when nothing reads them any more. Rows that are large each ask for smaller batches. Cuts hold
    whole texts and long lists, which zstd writes in two thirds of the default's disk.
    """
    conf = df.sparkSession.conf
    wanted = _WHILE_WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        path = new_path(df.sparkSession, "cut")
        df.write.mode("error").option("compression", "zstd").parquet(path)
        written = df.sparkSession.read.schema(df.schema).parquet(path)
        written._cut_path = path
        return written
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def release(*cuts: DataFrame) -> None:
    """Delete cuts of ``once`` whose readers have been written themselves; other frames are left alone."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
