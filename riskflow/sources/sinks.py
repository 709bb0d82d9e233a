"""Sinks. Every writer is a plain DataFrameWriter call; large tables are
partitioned on a low-cardinality column so later reads prune partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitioned_write(df: DataFrame, path: str, col: str, mode: str = "overwrite") -> None:
    """Write partitioned by ``col`` after a REBALANCE on it: AQE groups rows of
    a partition value into advisory-sized tasks (a large month is split, small
    months are merged), so the file count follows the data size instead of
    tasks x partition values."""
    df.hint("rebalance", col).write.mode(mode).partitionBy(col).parquet(path)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Panel / verified panel, partitioned by month (snapshot reads prune)."""
    partitioned_write(df, path, "observation_month", mode)


def write_transitions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    partitioned_write(df, path, "observation_month", mode)


def write_matrix(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Long-form matrix (or counts). CSV output is one small file with a header."""
    if fmt == "csv":
        df.coalesce(1).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_forecasts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table for all horizons, partitioned by ``horizon`` (one folder each)."""
    partitioned_write(df, path, "horizon", mode)


def group_file_key(col: str) -> F.Column:
    """File-name key of a group: upper case, spaces -> underscores."""
    return F.upper(F.translate(F.col(col), " ", "_"))


def write_group_matrices(df: DataFrame, path: str, group_col: str, mode: str = "overwrite") -> None:
    partitioned_write(df.withColumn("group_key", group_file_key(group_col)), path, "group_key", mode)


def write_watchlist(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_absorption(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """N, B, Q, R and the time table, each a long table under its own folder."""
    for name, t in tables.items():
        t.write.mode(mode).parquet(f"{path}/{name}")


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
