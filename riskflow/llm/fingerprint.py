"""Document fingerprints from improbable byte windows in chained Bloom filters.

1. Features are windows of ``WINDOW`` bytes of the UTF-8 text that begin at a
   word (after white space, or the text's start), so an insertion moves them
   but does not change them. In a run without white space that is longer than a
   window (prose in scripts without blanks, encoded data) they begin at every
   character from which the run holds a whole window and at its last window, so
   every byte is in a window. A text shorter than a window is one feature.
2. Each window's entropy is put into one of ``BINS`` bins. A corpus pass counts
   the windows per bin over all documents (a table of at most ``BINS`` rows);
   the fewer windows a bin holds, the rarer - the more improbable - its windows.
3. Windows are ranked by rarity. In every run of ``NEIGHBOURS`` consecutive
   windows the rarest (the leftmost of equals) wins; windows that win at least
   ``LEAST_WINS`` runs are selected.
4. A selected window sets ``HASHES`` bits in a Bloom filter of ``FILTER_BITS``
   bits. A filter takes ``FILTER_FEATURES`` different features, then a new one
   is chained.
5. Two fingerprints are compared filter by filter: common bits above what
   chance gives, over the most that could be common. Each filter of the shorter
   chain takes its best partner; the mean, weighted by features, is the
   likeness (0 to 1).

Neighbouring documents are brought together by one exchange: ids alone give
slices, the summed lengths of slices the ranges, texts are dealt to their range's
task and sorted, and each task streams over its range with one row of
look-ahead. The edited text takes over the windows measured in its two parts. The first row of every range is also sent
to the range before it (the first of all to the last).

Defined cases: a null text is empty and its fingerprint is empty; two empty
fingerprints have likeness 1, one empty and one not have 0. Documents are
ordered by descending id, null ids last, ties by the text's hash; with one
document it is its own neighbour. Repeated rows are documents like any other.
Only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship

__all__ = ["fit_rarity", "Fingerprinter", "likeness", "fingerprint", "fingerprint_documents", "with_next"]

WINDOW = 32
BINS = 1000
NEIGHBOURS = 4
LEAST_WINS = 2
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
STEP = 1 << 13          # windows measured at once
RANGE_ROWS = 4000       # rows per range of neighbouring documents, as long as there are no more than
MAX_RANGES = 10_000     # ranges: the driver holds one border and one head per slice of a range
SLICES = 8              # slices of ids per range: their summed lengths decide where ranges begin

_XLOGX = np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)])
_STEPS, _MOST = np.diff(_XLOGX), _XLOGX[-1]
_odd = np.random.default_rng(20240917).integers(1, 2 ** 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _starts(data: np.ndarray) -> np.ndarray:
    """Where words begin and every character of a run longer than a window, as
    far as a whole window follows."""
    blank = data <= 32
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = blank[:-1] & ~blank[1:]
    edges = np.flatnonzero(np.concatenate(([True], blank, [True])))
    for k in np.flatnonzero(np.diff(edges) > WINDOW + 1):
        # continuation bytes of UTF-8 begin no character
        run = slice(edges[k], edges[k + 1] - WINDOW)
        first[run] |= (data[run] & 0xC0) != 0x80
        first[run.stop - 1] = True            # the run's last bytes, wherever a character begins
    return np.flatnonzero(first[:len(data) - WINDOW + 1])


def _entropies(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The entropy bin of the window at each start, some windows at a time."""
    out = np.empty(len(starts), np.int64)
    offsets = np.arange(WINDOW)
    for k in range(0, len(starts), STEP):
        part = np.sort(data[starts[k:k + STEP, None] + offsets], axis=1)
        # where each byte stands in its run of equals: c bytes add up to c log c
        begins = np.where(np.diff(part, axis=1, prepend=part[:, :1]) != 0, offsets, 0)
        total = _STEPS[offsets - np.maximum.accumulate(begins, axis=1)].sum(axis=1)
        out[k:k + STEP] = np.minimum((1.0 - total / _MOST) * BINS, BINS - 1)
    return out


def _as_array(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


class Fingerprinter:
    """``rarity[b]``: rank of entropy bin ``b``, 0 the rarest."""

    def __init__(self, rarity: list[int]):
        self.rarity = np.asarray(rarity, np.int64)

    @staticmethod
    def measured(text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text's bytes and the bin of the window that begins at each of them, -1 where none does."""
        data = _as_array(text)
        bins = np.full(len(data), -1, np.int16)
        if len(data) >= WINDOW:
            starts = _starts(data)
            bins[starts] = _entropies(data, starts)
        return data, bins

    @staticmethod
    def joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], head: int, tail: int):
        """What ``measured`` gives for the first ``head`` bytes of ``a`` followed by the
        first ``tail`` of ``b``: windows inside either part are known, those over
        the border, and those that only now begin anywhere, are measured."""
        data = np.concatenate([a[0][:head], b[0][:tail]])
        bins = np.full(len(data), -1, np.int16)
        if len(data) < WINDOW:
            return data, bins
        known = bins.copy()
        known[:max(0, head - WINDOW + 1)] = a[1][:max(0, head - WINDOW + 1)]
        known[head:head + max(0, tail - WINDOW + 1)] = b[1][:max(0, tail - WINDOW + 1)]
        starts = _starts(data)
        found = known[starts]
        new = np.flatnonzero(found < 0)
        found[new] = _entropies(data, starts[new])
        bins[starts] = found
        return data, bins

    def features(self, measured: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Hashes of the selected windows, in text order."""
        data, bins = measured
        if not len(data):
            return np.empty(0, np.uint64)
        if len(data) < WINDOW:
            return self._hash(np.pad(data, (0, WINDOW - len(data)))[None, :])
        starts = np.flatnonzero(bins >= 0)
        rank = self.rarity[bins[starts]]
        if len(rank) > NEIGHBOURS:
            runs = np.lib.stride_tricks.sliding_window_view(rank, NEIGHBOURS)
            wins = np.bincount(np.arange(len(runs)) + runs.argmin(axis=1), minlength=len(rank))
            chosen = np.flatnonzero(wins >= LEAST_WINS)
            if not len(chosen):
                chosen = np.flatnonzero(wins)
        else:
            chosen = np.arange(len(rank))
        offsets = np.arange(WINDOW)
        return np.concatenate([self._hash(data[starts[chosen[k:k + 4096], None] + offsets])
                               for k in range(0, len(chosen), 4096)])

    @staticmethod
    def _hash(windows: np.ndarray) -> np.ndarray:
        x = (windows.astype(np.uint64) + np.uint64(1)) @ _odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x

    def filters(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Chained filters as a bit matrix and the features in each."""
        return self.chained(self.measured(text))

    def chained(self, measured: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``filters`` of a measured text."""
        found = self.features(measured)
        _, first = np.unique(found, return_index=True)
        found = found[np.sort(first)]
        count = -(-len(found) // FILTER_FEATURES)
        bits = np.zeros((count, FILTER_BITS), np.uint8)
        row = np.arange(len(found)) // FILTER_FEATURES
        for k in range(HASHES):
            bits[row, ((found >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
        return bits, np.bincount(row, minlength=count)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1 for two results of :meth:`Fingerprinter.filters`."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 1.0 if not len(b[0]) else 0.0
    wide = [x[0].astype(np.float32) for x in (a, b)]
    ones = [x.sum(axis=1) for x in wide]
    best = np.zeros(len(wide[0]), np.float32)
    for k in range(0, len(wide[1]), 512):
        part = slice(k, k + 512)
        common = wide[0] @ wide[1][part].T
        chance = ones[0][:, None] * ones[1][None, part] / FILTER_BITS
        most = np.minimum(ones[0][:, None], ones[1][None, part])
        room = np.maximum(most - chance, 1e-6)
        best = np.maximum(best, ((common - chance) / room).max(axis=1))
    return float(np.clip(np.average(np.clip(best, 0, 1), weights=a[1]), 0.0, 1.0))


def as_text(filters: tuple[np.ndarray, np.ndarray]) -> str:
    """``features:base64`` per filter, joined by a semicolon."""
    import base64
    return ";".join(f"{n}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}"
                    for bits, n in zip(*filters, strict=True))


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    import base64
    parts = [p.split(":") for p in text.split(";")] if text else []
    bits = [np.unpackbits(np.frombuffer(base64.b64decode(b), np.uint8)) for _, b in parts]
    return (np.array(bits, np.uint8).reshape(len(parts), FILTER_BITS), np.array([int(n) for n, _ in parts], np.int64))


def _histogram(batches: Iterator) -> Iterator:
    import pyarrow as pa
    counts = np.zeros(BINS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            data = _as_array(text or "")
            if len(data) >= WINDOW:
                counts += np.bincount(_entropies(data, _starts(data)), minlength=BINS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())],
                                     names=["bin", "n"])


def fit_rarity(df: DataFrame, text_col: str = "text") -> list[int]:
    """Rank of every entropy bin over all windows of all documents; bins that
    never occur come first, ties by bin. The result has ``BINS`` numbers."""
    ship(df)
    rows = (df.select(F.col(text_col).alias("_text")).mapInArrow(_histogram, "bin int, n bigint")
              .groupBy("bin").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(BINS, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    rank = np.empty(BINS, np.int64)
    rank[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return rank.tolist()


def fingerprint(df: DataFrame, rarity: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint``. No exchange."""
    ship(df)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        maker = Fingerprinter(rarity)
        for batch in batches:
            prints = [as_text(maker.filters(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())],
                                             names=["_id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .mapInArrow(run, f"_id {kind}, fingerprint string").withColumnRenamed("_id", id_col))


def with_next(df: DataFrame, id_col: str, text_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows ``_id, _text, _range, _extra`` dealt to ranges of neighbouring ids
    and sorted; ``_extra`` rows are the first of the next range."""
    from pyspark.ml.feature import Bucketizer

    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    spark = df.sparkSession
    ranges = min(MAX_RANGES, max(1, -(-rows.count() // range_rows)))
    slices = ranges * SLICES
    borders: list[float] = []
    if ranges > 1:
        share = [k / slices for k in range(1, slices)]
        ids = rows.where(F.col("_id").isNotNull()).select(F.col("_id").cast("double").alias("_id"))
        borders = sorted(set(ids.approxQuantile("_id", share, 0.2 / slices)))
    # slices are numbered in reading order: the largest ids come first, null ids last
    if borders:
        inf = float("inf")
        cut = Bucketizer(splits=[-inf, *borders, inf], inputCol="_x", outputCol="_low", handleInvalid="keep")
        rows = cut.transform(rows.withColumn("_x", F.coalesce(F.col("_id").cast("double"), F.lit(-inf))))
        rows = rows.select("_id", "_text", (len(borders) - F.col("_low")).cast("int").alias("_slice"))
    else:
        rows = rows.withColumn("_slice", F.lit(0))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    # ~id turns the order round without overflow; null ids come last
    order = F.struct(F.col("_id").isNull().alias("n"), F.bitwise_not(F.coalesce(F.col("_id"), F.lit(0))).alias("i"),
                     F.col("_tie").alias("t"))
    # consecutive slices of about one range's bytes are a range
    found = sorted(rows.groupBy("_slice").agg(F.min(order).alias("h"), F.sum(F.octet_length("_text") + 64).alias("b")).collect(),
                   key=lambda r: r["_slice"])
    each = max(1.0, sum(r["b"] for r in found) / ranges)
    heads, place, held = {}, {}, 0
    for r in found:
        k = int(held / each)
        place[r["_slice"]] = k
        heads.setdefault(k, (r["h"]["n"], r["h"]["i"], r["h"]["t"]))
        held += r["b"]
    ordered = sorted(heads)
    number = {k: i for i, k in enumerate(ordered)}
    heads = {number[k]: h for k, h in heads.items()}
    ordered = sorted(heads)
    places = spark.createDataFrame([(s, number[k]) for s, k in place.items()] or [(0, 0)], "_s int, _range int")
    rows = rows.join(F.broadcast(places), F.col("_slice") == F.col("_s")).select("_id", "_text", "_range", "_tie")
    sent = [(*heads[k], ordered[ordered.index(k) - 1]) for k in ordered]
    head = spark.createDataFrame(sent or [(False, 0, 0, 0)], "_n boolean, _i bigint, _t bigint, _to int")
    extra = (rows.join(F.broadcast(head), (F.col("_tie") == F.col("_t"))
                       & (F.bitwise_not(F.coalesce(F.col("_id"), F.lit(0))) == F.col("_i"))
                       & (F.col("_id").isNull() == F.col("_n")))
                 .select("_id", "_text", F.col("_to").alias("_range"), "_tie", F.lit(1).alias("_extra")))
    both = rows.select("_id", "_text", "_range", "_tie", F.lit(0).alias("_extra")).unionByName(extra)
    return (both.repartitionById(max(1, len(ordered)), F.col("_range"))
                .sortWithinPartitions("_range", "_extra", F.col("_id").desc_nulls_last(), "_tie")
                .select("_id", "_text", "_range", "_extra"))


OUT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: id, ``n_chars``, the fingerprints of the text and of its edited
    text (its last half replaced by the beginning of the next document), and the
    likeness to the edited text and to the next document."""
    ship(df)
    rarity = fit_rarity(df, text_col)
    names = ["_id"] + [c.split(" ")[0] for c in OUT.split(", ")]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pandas as pd
        maker = Fingerprinter(rarity)
        # the row that waits for its successor: (id, text, filters, range, extra, measured)
        held, out = None, []

        def row(now, text, filters, measured):
            half = len(now[1]) // 2
            kept, put = now[1][:len(now[1]) - half], text[:half]
            edited = kept + put
            if edited == now[1]:
                changed = now[2]
            else:
                changed = maker.chained(maker.joined(now[5], measured, len(_as_array(kept)), len(_as_array(put))))
            return (now[0], len(now[1]), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                    as_text(now[2]), as_text(changed), likeness(now[2], changed), likeness(now[2], filters))

        for pdf in batches:
            for r in zip(pdf["_id"], pdf["_text"], pdf["_range"], pdf["_extra"], strict=True):
                _id, text, place, extra = r
                waits = held is not None and held[3] == place and not held[4]
                if extra and not waits:
                    continue          # a repeated first row: only one is needed
                measured = maker.measured(text)
                filters = maker.chained(measured)
                if waits:
                    out.append(row(held, text, filters, measured))
                held = (_id, text, filters, place, extra, measured)
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = with_next(df, id_col, text_col, range_rows)
    return (rows.withColumn("_id", F.col("_id").cast("string"))
                .mapInPandas(run, f"_id string, {OUT}")
                .withColumn("_id", F.col("_id").cast(kind)).withColumnRenamed("_id", id_col))
