"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: all targets share
``total_share`` times the words of all documents by weight; a target stops at
``max_repeats`` times its source's words and the excess is shared again by
weight among the others (the water level below solves this in one step).

Within a source every document expects ``r = target / source words`` copies.
Documents are put in a fixed order (size, hash of the id, id); the running sum
of expected copies plus one offset per source crosses an integer boundary once
per copy. Because neighbours in that order have like sizes, the words taken
stay near the target, and since ``r <= max_repeats`` no document is taken more
often than ``max_repeats`` times when that is a whole number.

Ranks inside a source come from three bounded prefix sums instead of one
window per source, so a source with a third of all rows is not gathered:
distinct sizes per source, hash prefixes per (source, size), and rows per
(source, size, prefix).

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and takes nothing. Rows
repeated with one id are documents like any other (ties are broken by the
text's hash; identical rows are interchangeable). An empty table gives an
empty result. Only id, text and source are read by :func:`plan_mix`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["WORD", "WEIGHTS", "source_targets", "plan_mix", "mix"]

# Fixed values of the task: what counts as a word, and the repeating weights.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"),
                     F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("_size"),
                     F.md5(text.cast("binary")).alias("_tie"))


def _totals(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("_src").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_rows"))


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, total_share: float = 1.5,
                   max_repeats: int = 2) -> DataFrame:
    """``_src, _words`` per source -> also ``_weight, _target``.

    The table has one row per source, so its windows are small. Sorted by
    cap / weight, the water level is the first ``(total - caps so far) /
    (weight left)`` that does not lift the next source above its cap.
    """
    order = Window.orderBy(F.col("_src").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("_weight", pick).withColumn("_cap", F.col("_words") * max_repeats)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("_words").over(everything) * F.lit(float(total_share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(rest)
    t = t.withColumn("_level", level)
    # the first source (in ratio order) whose own level stays below its cap sets the water level
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    t = t.withColumn("_water", F.first(fits, ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_water").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.col("_water") * F.col("_weight")))
    return t.select("_src", "_words", "_weight", target.alias("_target"))


def _offset(src, seed: str):
    """One number in [0, 1) per source, fixed by the seed and the source."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), src), F.lit("null")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
            / F.lit(4294967296.0))


def _ranked(sizes: DataFrame, hash_digits: int) -> DataFrame:
    """Adds ``_rank``: 1, 2, ... within the source by (size, hash prefix, id)."""
    s = sizes.withColumn("_pre", F.substring(F.md5(F.col("_id").cast("string").cast("binary")),
                                             1, hash_digits))
    # a null id hashes to null; give it a prefix of its own text so it spreads too
    s = s.withColumn("_pre", F.coalesce("_pre", F.substring("_tie", 1, hash_digits)))
    cells = s.groupBy("_src", "_size", "_pre").agg(F.count(F.lit(1)).alias("_n"))
    levels = cells.groupBy("_src", "_size").agg(F.sum("_n").alias("_n"))
    up = Window.partitionBy("_src").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select(F.col("_src").alias("_ls"), F.col("_size").alias("_lz"),
                           F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_below"))
    in_level = (Window.partitionBy("_src", "_size").orderBy("_pre")
                .rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("_src").alias("_cs"), F.col("_size").alias("_cz"), F.col("_pre").alias("_cp"),
                         F.coalesce(F.sum("_n").over(in_level), F.lit(0)).alias("_in"))
    cells = cells.join(levels, F.col("_cs").eqNullSafe(F.col("_ls")) & (F.col("_cz") == F.col("_lz")))
    own = Window.partitionBy("_src", "_size", "_pre").orderBy(F.col("_id").asc_nulls_last(), "_tie")
    s = s.withColumn("_own", F.row_number().over(own))
    s = s.join(cells, F.col("_src").eqNullSafe(F.col("_cs")) & (F.col("_size") == F.col("_cz"))
               & (F.col("_pre") == F.col("_cp")))
    return s.withColumn("_rank", F.col("_below") + F.col("_in") + F.col("_own"))


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = WEIGHTS, total_share: float = 1.5, max_repeats: int = 2,
             seed: str = "mix", hash_digits: int = 3) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken, source, text_md5."""
    sizes = _sizes(df, id_col, text_col, source_col)
    targets = source_targets(_totals(sizes), weights, total_share, max_repeats)
    t = targets.select(F.col("_src").alias("_ts"), "_words", "_target",
                       F.when(F.col("_words") > 0, F.col("_target") / F.col("_words"))
                        .otherwise(F.lit(0.0)).alias("_r"),
                       _offset(F.col("_src"), seed).alias("_u"))
    # one row per source; whether it is small enough to broadcast is left to the measured size
    s = _ranked(sizes, hash_digits).join(t, F.col("_src").eqNullSafe(F.col("_ts")))
    copies = (F.floor(F.col("_r") * F.col("_rank") + F.col("_u"))
              - F.floor(F.col("_r") * (F.col("_rank") - 1) + F.col("_u")))
    return s.select(F.col("_id").alias(id_col), F.col("_size").alias("size"),
                    F.col("_words").alias("source_size"), F.col("_target").alias("target"),
                    copies.alias("copies"), (copies * F.col("_size")).alias("taken"),
                    F.col("_src").alias(source_col), F.col("_tie").alias("text_md5"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **options) -> DataFrame:
    """The mixed corpus: every document as often as the plan takes it, with all
    its columns. Rows repeated with one id, text and source are interchangeable:
    one of them stands for all and is repeated as often as the plan takes them
    together."""
    plan = plan_mix(df, id_col, text_col, source_col, **options)
    key = [F.col(id_col).cast("string"), F.col("text_md5"), F.col(source_col)]

    def joined(*parts):
        return F.to_json(F.array(*parts), {"ignoreNullFields": "false"})

    def free(name):
        while name.lower() in (c.lower() for c in df.columns):
            name = "_" + name
        return name

    own, number, copy = free("_mix_own"), free("_mix_rn"), free("_mix_e")
    wanted, times = free("_mix_key"), free("_mix_n")
    take = (plan.groupBy(joined(*key).alias(wanted)).agg(F.sum("copies").cast("int").alias(times))
                .where(F.col(times) > 0))
    md5 = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    once = Window.partitionBy(own).orderBy(own)
    rows = (df.withColumn(own, joined(F.col(id_col).cast("string"), md5, F.col(source_col)))
              .withColumn(number, F.row_number().over(once)).where(F.col(number) == 1))
    return (rows.join(take, rows[own] == take[wanted])
                .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
                .select(*[F.col(f"`{c}`") for c in df.columns]))
