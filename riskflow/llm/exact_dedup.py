"""Exact deduplication by a 128-bit content hash (DataFrame functions only).

Plan
  1. One pass hashes every text (MD5, 128 bits) and writes ids and hashes to
     the shared folder. Only these are grouped: partial counts per map task,
     so a group holding a third of the table arrives as one row per task.
  2. Hashes shared by several rows are checked byte for byte: their texts are
     written out, and per hash the smallest and the largest text must be the
     same string. The texts of a group are reduced map-side, so no group's
     texts meet in one task. Hashes
     whose texts differ (a collision) are split again by the text itself; their
     table is empty but for collisions, so Spark sees from its file size that
     joins with it need no exchange.
  3. Rows fetch their group's survivor by a join of two written tables on the
     hash: adaptive execution splits a skewed hash.

Defined cases: a null text counts as the empty text; all empty texts form one
group. Rows with a null id are grouped like others and survive only where the
whole group has no id. Rows repeated with the same id and text count each in
``group_size``; they are all marked, and :func:`drop_duplicates` returns one of
them. Only the id and text columns are read, so extra columns cannot clash.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stash

__all__ = ["exact_groups", "drop_duplicates"]


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("_id"), text.alias("_text"),
                     F.unhex(F.md5(text.cast("binary"))).alias("_h"),
                     F.sha2(text.cast("binary"), 256).alias("_sha"))


def _clashes(texts: DataFrame) -> DataFrame:
    """Hashes (``_c``) that stand for more than one text, by comparing bytes."""
    return (texts.groupBy("_h").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"))
                 .where("_lo <> _hi").select(F.col("_h").alias("_c")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "largest") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` (of the text in UTF-8)."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    pick = F.max if keep == "largest" else F.min
    members = [pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")]
    rows = _hashed(df, id_col, text_col)
    ids = stash(rows.select("_id", "_h", "_sha"), "dedup-ids")
    by_hash = stash(ids.groupBy(F.col("_h").alias("_gh")).agg(*members), "dedup-groups")
    shared = by_hash.where("_n > 1")
    # written between the join and the grouping: a skewed hash is split in the join
    # and reduced per task before the grouping's exchange
    texts = stash(rows.join(shared, rows["_h"] == shared["_gh"], "left_semi"), "dedup-texts")
    clash = stash(_clashes(texts), "dedup-clash")

    whole = ids.join(by_hash, ids["_h"] == by_hash["_gh"]).join(clash, F.col("_gh") == F.col("_c"), "left_anti")
    apart = texts.join(clash, texts["_h"] == clash["_c"], "left_semi")
    by_text = apart.groupBy(F.col("_text").alias("_gt")).agg(*members)
    split = apart.join(by_text, apart["_text"] == by_text["_gt"])
    cols = ["_id", "_sha", "_keep", "_n"]
    return whole.select(*cols).unionByName(split.select(*cols)).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    keep: str = "largest") -> DataFrame:
    """The rows of ``df`` that survive, with all their columns, one per text.

    A row's key is its id and text hash. Rows repeated with one key are cut to
    one (before the exchange too, so a hot key arrives as one row per task),
    then the keys that lost are removed by an anti join on the same key: the
    texts are exchanged once.
    """
    mark = "_row_key"
    while mark in df.columns:
        mark += "_"

    def key(id_value, sha):
        return F.concat_ws(":", F.coalesce(id_value.cast("string"), F.lit("null")), sha)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    lost = (exact_groups(df, id_col, text_col, keep).where("not kept")
            .select(key(F.col(id_col), F.col("text_sha256")).alias("_lost")))
    first = Window.partitionBy(mark).orderBy(F.col(mark))
    rows = (df.withColumn(mark, key(F.col(id_col), F.sha2(text, 256)))
              .withColumn(mark + "n", F.row_number().over(first))
              .where(F.col(mark + "n") == 1).drop(mark + "n"))
    return rows.join(lost, rows[mark] == lost["_lost"], "left_anti").drop(mark)
