"""Divergence of the sources of a language by their words, recounted through
minimal perfect hashes.

1. *Filter.* A first pass counts in how many documents of its language each
   term (a run of letters and of characters beyond ASCII, A to Z lower-cased)
   occurs; tasks add up their own documents first. The terms that reach
   ``LEAST_DOCS`` are kept.
2. *Hash.* A language's kept terms are dealt to shards of at most about
   ``SHARD_TERMS`` by their hash. Every shard gets a minimal perfect hash (buckets of terms, the
   largest first, each with the displacement that puts its terms on free slots;
   buckets of one term name their slot) and stores its terms in slot order.
3. *Recount.* The shards are broadcast and a second pass looks every term up:
   shard, bucket, displacement, slot, and the stored term, which tells kept terms
   from others. A hit adds to the slot of its (language, source) group. Tasks
   hold dense slots for at most ``TASK_SLOTS`` and pass on the slots in use.
   A broadcast holds about ``ROUND_BYTES``: kept terms beyond it take further
   rounds over the texts with the other shards, whatever the size.
4. *Audit.* Per group and shard the counts become a dense vector of smoothed
   shares in billionths. Sources are compared shard by shard and the sums
   added; a group's terms are compared with its language's. Whole numbers all
   the way: shares are long divisions in base 1000, exact while a group has
   fewer than 9 * 10**15 words.

A hot language or source is only ever a key of sums that combine before their
shuffle, or one row among its shard's rows.

Defined cases: null text, language and source are empty ones. A group without
terms counts nothing but is compared like others; a language without a kept term
gives value 0 to each pair and no term. Only those three columns are read. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import ship, stash

__all__ = ["audit", "kept_terms", "build_hashes", "recount", "build_shard", "ShardedHash"]

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000

SHARD_TERMS = 4096
ROUND_BYTES = 24 << 20
TASK_SLOTS = 8 << 20
HELD_TERMS = 300_000      # distinct terms a task holds
HELD_WORDS = 1 << 20      # words a task reads before it looks them up
_SEED = 42

_TERMS = re.compile(rb"[a-z\x80-\xff]+").findall     # in UTF-8 every byte of a character beyond ASCII is >= 0x80
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def terms(text: str) -> list[bytes]:
    return _TERMS(text.encode().translate(_LOWER))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    import xxhash
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))


def _n_buckets(n):
    return n // 3 + 1


def _slots(h: np.ndarray, tries, n) -> np.ndarray:
    return (_mix(h ^ (np.asarray(tries, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.asarray(n, np.uint64)).astype(np.int64)


def build_shard(keys: list[bytes]) -> tuple[int, list[int], list[bytes]]:
    """(seed, displacement per bucket, keys in slot order) of different keys. A
    displacement t >= 0 is the number of the hash that places the bucket's keys,
    -1 - s names the slot of the bucket's only key."""
    n, m, seed = len(keys), _n_buckets(len(keys)), _SEED
    while True:
        h = _hashes(keys, seed)
        if len(np.unique(h)) == n:
            break
        seed += 1                      # two keys with one hash would share every slot
    bucket = (_mix(h) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=m)
    ends = np.cumsum(sizes)
    free = np.ones(n, bool)
    shift, place = np.zeros(m, np.int64), np.empty(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        k = int(sizes[b])
        if k < 2:
            break
        own = order[ends[b] - k:ends[b]]
        at = 0
        while True:
            tries = np.arange(at, at + 64)
            s = _slots(h[own][None, :], tries[:, None], n)
            ok = free[s].all(axis=1)
            inner = np.sort(s, axis=1)
            ok &= (inner[:, 1:] != inner[:, :-1]).all(axis=1)
            if ok.any():
                t = int(np.argmax(ok))
                shift[b], place[own] = at + t, s[t]
                free[s[t]] = False
                break
            at += 64
    left = np.flatnonzero(free)
    for s, b in zip(left, np.flatnonzero(sizes == 1)):
        shift[b], place[order[ends[b] - 1]] = -1 - s, s
    stored = [b""] * n
    for key, s in zip(keys, place):
        stored[s] = key
    return seed, shift.tolist(), stored


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class ShardedHash:
    """Look-up in some shards of one language; ``shards``: number, seed,
    displacements, stored keys. Slots count through all shards that are present."""

    def __init__(self, n_shards: int, shards: list[tuple[int, int, list[int], list[bytes]]]):
        self.n_shards = n_shards
        shards = sorted(shards)
        self.numbers = np.array([s[0] for s in shards], np.int64)
        self.size = np.zeros(n_shards, np.int64)
        self.base, self.first, self.seed = (np.zeros(n_shards, np.int64) for _ in range(3))
        self.ends = np.cumsum([len(s[3]) for s in shards])
        at = bucket = 0
        for number, seed, shift, keys in shards:
            self.size[number], self.base[number], self.first[number], self.seed[number] = len(keys), at, bucket, seed
            at, bucket = at + len(keys), bucket + len(shift)
        self.shift = np.array([x for s in shards for x in s[2]], np.int64)
        self.keys = [k for s in shards for k in s[3]]
        self.slots = at

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words that are kept, their slots)."""
        h = _hashes(words, _SEED)
        shard = np.mod(h.view(np.int64), self.n_shards)
        at = np.flatnonzero(self.size[shard] > 0)
        h, shard = h[at], shard[at]
        for i in np.flatnonzero(self.seed[shard] != _SEED):
            h[i] = _hashes([words[at[i]]], int(self.seed[shard[i]]))[0]
        n = self.size[shard]
        shift = self.shift[self.first[shard] + (_mix(h) % _n_buckets(n).astype(np.uint64)).astype(np.int64)]
        slot = self.base[shard] + np.where(shift < 0, -1 - shift, _slots(h, np.maximum(shift, 0), n))
        keys = self.keys
        same = np.fromiter((keys[s] == words[w] for s, w in zip(slot.tolist(), at.tolist())), bool, len(at))
        return at[same], slot[same]

    def shard_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard numbers and the slots' places inside them."""
        number = self.numbers[np.searchsorted(self.ends, slots, side="right")]
        return number, slots - self.base[number]


def _texts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                       for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def kept_terms(texts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term of the terms in at least ``least`` documents of the language, with the shards of the language."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(held):
            for lang, found in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()),
                     pa.array(list(found.values()), pa.int64())], names=["lang", "term", "n"])

        held: dict[str, Counter] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                held.setdefault(langs[i], Counter()).update(set(terms(batch.column(1)[i].as_py())))
                if i % 64 == 0 and sum(map(len, held.values())) > HELD_TERMS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    kept = stash(texts.select("lang", "text").mapInArrow(run, "lang string, term string, n bigint")
                 .groupBy("lang", "term").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select("lang", "term"),
                 "div-kept")
    # one number for all languages, by the largest: nothing is joined, or dealt, by language
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    shards = max(1, -(-most // SHARD_TERMS))
    return kept.withColumn("shards", F.lit(shards)).withColumn(
        "shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))


def build_hashes(kept: DataFrame) -> DataFrame:
    """One row per shard: lang, shards, shard, seed, shift, keys (terms in slot order)."""
    def build(key, table):
        import pyarrow as pa
        seed, shift, keys = build_shard(table.column("term").cast(pa.binary()).to_pylist())
        return pa.table({
            "lang": [key[0].as_py()], "shards": pa.array([key[2].as_py()], pa.int32()),
            "shard": pa.array([key[1].as_py()], pa.int32()), "seed": pa.array([seed], pa.int64()),
            "shift": pa.array([shift], pa.list_(pa.int64())),
            "keys": pa.array([keys], pa.list_(pa.binary())).cast(pa.list_(pa.string()))})

    return stash(kept.groupBy("lang", "shard", "shards").applyInArrow(
        build, "lang string, shards int, shard int, seed bigint, shift array<bigint>, keys array<string>"), "div-hash")


def _recount_round(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    rows = hashes.collect()            # about ROUND_BYTES: recount() sees to it
    by_lang: dict[str, tuple[int, list]] = {}
    for r in rows:
        by_lang.setdefault(r.lang, (r.shards, []))[1].append((r.shard, r.seed, list(r["shift"]), [k.encode() for k in r["keys"]]))
    sent = texts.sparkSession.sparkContext.broadcast(by_lang)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        found = {lang: ShardedHash(*x) for lang, x in sent.value.items()}
        number: dict[str, _Numbers] = {lang: _Numbers() for lang in found}       # terms in the order they came
        slot_of = {lang: np.empty(0, np.int64) for lang in found}                # of the terms looked up so far
        held: dict[tuple[str, str], list[np.ndarray]] = {}                       # numbers of the terms read since
        dense: dict[tuple[str, str], np.ndarray] = {}                            # the last slot takes terms that are not kept
        waiting = 0

        def passed_on():
            for (lang, source), counts in dense.items():
                used = np.flatnonzero(counts[:-1])
                number, place = found[lang].shard_of(used)
                for s in np.unique(number):
                    own = number == s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([source]), pa.array([s], pa.int32()),
                         pa.array([place[own]], pa.list_(pa.int32())),
                         pa.array([counts[used[own]]], pa.list_(pa.int64()))],
                        names=["lang", "source", "shard", "slots", "counts"])
            dense.clear()

        def looked_up():
            for lang, numbers in number.items():
                new = list(islice(numbers, len(slot_of[lang]), None))
                slots = np.full(len(new), found[lang].slots, np.int64)
                at, slot = found[lang].find(new)
                slots[at] = slot
                slot_of[lang] = np.concatenate([slot_of[lang], slots])
            for group, parts in held.items():
                size = found[group[0]].slots + 1
                if group not in dense:
                    if dense and sum(map(len, dense.values())) + size > TASK_SLOTS:
                        yield from passed_on()
                    dense[group] = np.zeros(size, np.int64)
                dense[group] += np.bincount(slot_of[group[0]][np.concatenate(parts)], minlength=size)
            held.clear()
            for lang, numbers in number.items():
                if len(numbers) > HELD_TERMS:
                    numbers.clear()
                    slot_of[lang] = slot_of[lang][:0]

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if langs[i] not in found:
                    continue
                words = terms(batch.column(2)[i].as_py())
                held.setdefault((langs[i], sources[i]), []).append(
                    np.fromiter(map(number[langs[i]].__getitem__, words), np.int64, len(words)))
                waiting += len(words)
                if waiting > HELD_WORDS:
                    yield from looked_up()
                    waiting = 0
        yield from looked_up()
        yield from passed_on()

    return texts.mapInArrow(run, "lang string, source string, shard int, slots array<int>, counts array<bigint>")


def recount(texts: DataFrame, hashes: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """lang, source, shard, slot, n: how often each kept term occurs in each group, where it does."""
    size = F.aggregate("keys", F.lit(0).cast("bigint"), lambda a, k: a + F.octet_length(k) + 48)
    sized = hashes.select("*", size.alias("_size"))
    total = sized.agg(F.sum("_size")).first()[0] or 0
    rounds = max(1, math.ceil(total / round_bytes))
    counts = None
    for k in range(rounds):
        part = hashes if rounds == 1 else hashes.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)) == k)
        found = _recount_round(texts, part)
        counts = found if counts is None else counts.unionByName(found)
    cells = counts.select("lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts")).alias("_c"))
    return stash(cells.groupBy("lang", "source", "shard", F.col("_c.slots").alias("slot"))
                 .agg(F.sum("_c.counts").alias("n")), "div-cells")


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    rest, out = counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return 1 + out


def _dense(grid: DataFrame, cells: DataFrame, by: list[str], name: str) -> DataFrame:
    """``by``, n, p: counts and shares in every slot of a row of ``grid`` (``by``, size, total)."""
    def fill(key, table):
        import pyarrow as pa
        counts = np.zeros(table.column("size")[0].as_py(), np.int64)
        slot = table.column("slot")
        if slot.null_count == 0:
            counts[slot.to_numpy()] = table.column("n").to_numpy()
        p = _shares(counts, table.column("total")[0].as_py())
        return pa.table({**{c: [k.as_py()] for c, k in zip(by, key)}, "n": pa.array([counts], pa.list_(pa.int64())),
                         "p": pa.array([p], pa.list_(pa.int64()))})

    kinds = ", ".join(f"{c} {'bigint' if c == 'shard' else 'string'}" for c in by)
    full = grid.withColumn("shard", F.col("shard").cast("bigint")).join(
        cells.withColumn("shard", F.col("shard").cast("bigint")), by, "left")
    return stash(full.groupBy(*by).applyInArrow(fill, f"{kinds}, n array<bigint>, p array<bigint>"), name)


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: a group's divergence from each other
    source of its language (part ``pair``) and the terms it uses more than the
    language does (part ``term``, the first ``top``)."""
    ship(df)
    texts = _texts(df, text_col, lang_col, source_col)
    hashes = build_hashes(kept_terms(texts, least))
    cells = recount(texts, hashes)

    kept = hashes.groupBy(F.col("lang").alias("_kl")).agg(F.sum(F.size("keys")).alias("kept"))
    sums = cells.groupBy(F.col("lang").alias("_sl"), F.col("source").alias("_ss")).agg(F.sum("n").alias("words"))
    groups = stash(texts.select("lang", "source").distinct()
                   .join(sums, (F.col("lang") == F.col("_sl")) & (F.col("source") == F.col("_ss")), "left")
                   .join(kept, F.col("lang") == F.col("_kl"), "left")
                   .select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"),
                           F.coalesce("kept", F.lit(0)).alias("kept")), "div-groups")

    # one row per shard: the small side of all that follows, so no row of a term is dealt by its language
    shards = hashes.select(F.col("lang").alias("_l"), F.col("shard").alias("_s"), F.size("keys").alias("size"))
    grid = stash(groups.join(shards, F.col("lang") == F.col("_l")).select(
        "lang", "source", F.col("_s").alias("shard"), "size", (F.col("words") + 2 * F.col("kept")).alias("total")), "div-grid")
    vectors = _dense(grid, cells, ["lang", "source", "shard"], "div-vectors")
    wholes = groups.groupBy("lang").agg((F.sum("words") + 2 * F.first("kept")).alias("total"))
    grid = stash(wholes.join(shards, F.col("lang") == F.col("_l")).select("lang", F.col("_s").alias("shard"), "size", "total"),
                 "div-grid")
    whole = _dense(grid, cells.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")), ["lang", "shard"], "div-whole")

    one, two = (vectors.select(*[F.col(c).alias(f"{s}_{c}") for c in ("lang", "source", "shard", "p")]) for s in ("x", "y"))
    apart = F.expr("aggregate(zip_with(x_p, y_p, (p, q) -> (p - q) * (p - q) div (p + q)), 0L, (a, v) -> a + v)")
    halves = (one.join(two, (F.col("x_lang") == F.col("y_lang")) & (F.col("x_shard") == F.col("y_shard"))
                       & (F.col("x_source") < F.col("y_source")))
              .groupBy(F.col("x_lang").alias("_l"), F.col("x_source").alias("_a"), F.col("y_source").alias("_b"))
              .agg(F.sum(apart).alias("value")))
    both = halves.select("_l", F.explode(F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")),
                                                 F.struct(F.col("_b").alias("a"), F.col("_a").alias("b")))).alias("_e"), "value")
    both = both.select(F.col("_l"), F.col("_e.a").alias("_a"), F.col("_e.b").alias("_b"), "value")
    sources = groups.select("lang", "source")
    others = sources.select(F.col("lang").alias("_ol"), F.col("source").alias("item"))
    pairs = (sources.join(others, (F.col("lang") == F.col("_ol")) & (F.col("source") != F.col("item")))
             .join(both, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_a")) & (F.col("item") == F.col("_b")), "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value")))

    stored = (whole.withColumnRenamed("p", "q").join(hashes.select("lang", F.col("shard").cast("bigint").alias("shard"), "keys"),
                                                     ["lang", "shard"])
              .select(F.col("lang").alias("_wl"), F.col("shard").alias("_ws"), "q", "keys"))
    used = (vectors.join(stored, (F.col("lang") == F.col("_wl")) & (F.col("shard") == F.col("_ws")))
            .select("lang", "source", F.explode(F.arrays_zip("n", "p", "q", "keys")).alias("_t"))
            .where("_t.n > 0 AND _t.p > _t.q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("_t.keys").alias("item"),
                    F.expr("(_t.p - _t.q) * (_t.p - _t.q) div (_t.p + _t.q)").alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = pairs.withColumn("rank", rank).unionByName(used.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select(F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank")

