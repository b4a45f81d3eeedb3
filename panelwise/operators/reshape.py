"""Column selection, wide/long reshaping and label handling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(
    names: Iterable[str], contains: str | None = None, starts: str | None = None, without: Iterable[str] = ()
) -> list[str]:
    """Column names picked by pattern, minus named ones, in table order."""
    without = set(without)
    return [
        n
        for n in names
        if (contains is None or contains in n) and (starts is None or n.startswith(starts)) and n not in without
    ]


def renamed(names: Iterable[str], old: str, new: str) -> list[str]:
    """One list of column names derived from another."""
    return [n.replace(old, new) for n in names]


def rename(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(labels))


def melt(
    df: DataFrame, ids: list[str], columns: list[str], variable: str = "variable", value: str = "value",
    kind: str | None = None,
) -> DataFrame:
    """Wide to long, nulls kept; ``kind`` casts the columns to one type first."""
    if kind is not None:
        df = df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns])
    return df.unpivot(ids, columns, variable, value)


def side_by_side(
    df: DataFrame, rows: list[str], across: str, values: list[str], cells: Column, missing=None
) -> DataFrame:
    """Long to wide: one output column per entry of ``values``, which is given so that no extra scan is needed."""
    wide = df.groupBy(*rows).pivot(across, values).agg(cells)
    return wide if missing is None else wide.na.fill(missing, subset=values)


def position(label: Column, order: list[str]) -> Column:
    """1-based place of a label in a fixed list, 0 for labels outside it."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), label)


def reindex(df: DataFrame, column: str, order: list[str], rank: str = "position") -> DataFrame:
    """Keep listed labels only and number them in list order."""
    return df.withColumn(rank, position(F.col(column), order)).filter(F.col(rank) > 0)


def complete(df: DataFrame, column: str, order: list[str], rank: str = "position") -> DataFrame:
    """As ``reindex``, and listed labels that do not occur are added with nulls."""
    rows = [(i + 1, label) for i, label in enumerate(order)]
    labels = df.sparkSession.createDataFrame(rows, f"`{rank}` int, `{column}` string")
    return labels.join(df, column, "left")


def last_wins(*lists: Iterable[str]) -> list[str]:
    """Lists joined; of a repeated label the last occurrence stays."""
    joined = [x for part in lists for x in part]
    return [x for i, x in enumerate(joined) if x not in joined[i + 1:]]


def all_rows(*frames: DataFrame) -> DataFrame:
    """Frames stacked by column name; a column that one lacks is null there."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def with_position(df: DataFrame, column: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of ``column`` in a fixed list; unlisted values share the place after it, missing ones have none."""
    listed = F.create_map(*[F.lit(x) for place, value in enumerate(order, 1) for x in (value, place)])
    place = F.coalesce(listed[F.col(column)], F.lit(len(order) + 1))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), place))
