"""Helpers shared by the text-corpus operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import ensure_checkpoint_dir, ensure_package_on_workers

__all__ = ["documents", "pages", "labels", "shared_folder", "stash", "ship", "slices", "fold", "unit_hash",
           "held_out"]

# Rows of a batch that a task turns into Python objects at a time.
SLICE_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder the session names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskflow-{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut
    and a lost executor costs a re-read of files, not a recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> SparkSession:
    """Make this package importable in the Python workers of ``df``'s session."""
    ensure_package_on_workers(df.sparkSession)
    return df.sparkSession


def slices(batches, rows: int = SLICE_ROWS):
    """Arrow batches of at most ``rows`` rows: what a task holds follows these, not
    the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def held_out(id_col) -> F.Column:
    """crc32 of the id as text leaves remainder 1 by 3: the held-out third."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fold(id_col, salt: str, parts: int) -> F.Column:
    """A stable pseudo-random number in [0, parts) from the id."""
    h = F.md5(F.concat_ws(":", F.lit(salt), F.col(id_col).cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % parts).cast("int")


def unit_hash(col, salt: str) -> F.Column:
    """A stable pseudo-random number in [0, 1) from a column's text."""
    h = F.md5(F.concat(F.lit(salt + ":"), col.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
