"""Near-duplicate classes by Order MinHash, verified by banded alignment.

1. Words (letters, digits, underscore; lower case) make shingles of
   ``SHINGLE`` words; a shorter text is one shingle. Documents with the same
   sequence of shingles are one node; only nodes are compared.
2. A node's sketch has ``TABLES`` values. Each takes the ``PICK`` smallest
   hashes among the occurrence-labelled shingles (the second occurrence of a
   shingle differs from the first) and hashes these shingles in text order. Two
   nodes share a value if their minima and the order of these agree, so the
   chance follows edit similarity, not only the common set. Where so few shingles
   leave little or no choice, chance is not relied on: a node of up to ``SHORT``
   shingles also has the keys of its sequence and of its sequence without each
   one, so that two such nodes that differ by one shingle always share a value.
3. Nodes that share a value form a bucket. Within a bucket pairs are not listed:
   every member is compared with a leader. Links join nodes into classes.
   Buckets that still hold several classes get a new leader, nodes without a
   link first, which is compared with the members of other classes; members of
   its own class cost nothing. A turn costs at most one pair per node and table,
   whatever the size of a bucket. When after ``LEAST_TURNS`` no open bucket has
   more than ``REST_NODES`` nodes or a turn finds no new link, or after
   ``MOST_TURNS``, open buckets are not given up:
   the nodes in them are joined by an exact prefix filter. Two nodes at
   ``SIMILARITY`` share one of their rarest labelled shingles, early enough that
   the rest of both can still make up the overlap; the lengths, that overlap and
   a bitmap of either's shingles leave pairs out only if they cannot pass.
4. A pair is verified by aligning the two shingle sequences. With insertions and
   deletions only, similarity = matches / alignment columns, so two texts
   without moved passages have exactly their shingles' Jaccard similarity. A
   pair at ``SIMILARITY`` or more differs by at most ``(1 - s) / (1 + s)`` of
   both lengths, which bounds the band the alignment has to visit: the result
   inside that band is exact for every pair that passes.
5. Classes are the connected components of the links, found by spreading the
   smallest label over links with shortcuts, each round written out.

Hot buckets, hot leaders and hot classes appear only as join keys between
written tables or as grouping keys of aggregates that combine map-side. Joins
ask for a sort-merge join, which adaptive execution can split, so the plan is
the same at every size.

Defined cases: null and empty texts and texts without a word are in no class
but their own (``class_id`` is the id, ``class_size`` 1). A class is named by
its smallest id; null ids are members but name a class only if all are null.
Where several texts have that id, the one of the smallest node is kept. Rows
repeated with one id and text are members each. Node keys are 64-bit
hashes of the whole sequence. Only id and text are read. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import ship, stash

__all__ = ["near_duplicate_classes", "drop_near_duplicates", "alignment_similarity", "Sketcher"]

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 32
PICK = 5
SHORT = 8             # shingles: two texts of no more that reach 0.8 differ by one shingle at most
LEAST_TURNS = 1
MOST_TURNS = 6
REST_NODES = 2000     # nodes of the largest open bucket that the exact join takes over at
SALT_ROWS = 2000      # nodes with one shingle that meet in one task of the rest's join
BITMAP = 8            # longs of a node's bitmap
_CACHE = 500_000
_CELLS = 1 << 21      # hashes held at once while sketching a long text

_rng = np.random.default_rng(7919)
_WORD_MULT = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_SEED = _rng.integers(1, 2 ** 63, 4096, dtype=np.uint64)
_PICK_MULT = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Sketcher:
    def __init__(self, shingle: int = SHINGLE, tables: int = TABLES, pick: int = PICK):
        self.shingle, self.tables, self.pick = shingle, tables, pick
        self.words, self.find = _WordHash(), re.compile(r"\w+").findall

    def shingles(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the shingles in text order."""
        found = self.find(text.lower()) if text else []
        if not found:
            return np.empty(0, np.uint64)
        table = self.words
        w = np.fromiter((table[x] for x in found), np.uint64, len(found))
        k = min(self.shingle, len(w))
        n = len(w) - k + 1
        out = np.full(n, len(w) if k < self.shingle else 0, np.uint64)
        for j in range(k):
            out += w[j:j + n] * _WORD_MULT[j]
        return _mix(out)

    @staticmethod
    def key(shingles: np.ndarray) -> int:
        """One signed 64-bit number for a whole sequence."""
        import xxhash
        return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))

    @staticmethod
    def labelled(shingles: np.ndarray) -> np.ndarray:
        """Shingles with their occurrence number mixed in."""
        order = np.argsort(shingles, kind="stable")
        s = shingles[order]
        same = np.empty(len(s), bool)
        same[0] = False
        same[1:] = s[1:] == s[:-1]
        if not same.any():
            return shingles
        place = np.arange(len(s))
        number = np.empty(len(s), np.int64)
        number[order] = place - np.maximum.accumulate(np.where(same, 0, place))
        # a first occurrence is the same whether or not its text repeats any shingle
        return np.where(number, _mix(shingles + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), shingles)

    def short_keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of a short sequence and of those with one shingle less; none for others."""
        if len(shingles) > SHORT:
            return np.empty(0, np.int64)
        less = [np.delete(shingles, i) for i in range(len(shingles))] if len(shingles) > 1 else []
        return np.array(sorted({self.key(x) for x in (shingles, *less)}), np.int64)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """One signed 64-bit value per table."""
        x = self.labelled(shingles)
        k = min(self.pick, len(x))
        out = np.empty(self.tables, np.uint64)
        step = max(1, _CELLS // len(x))
        for at in range(0, self.tables, step):
            seeds = _TABLE_SEED[at:min(self.tables, at + step), None]
            v = (x[None, :] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
            v ^= v >> np.uint64(32)
            low = np.argpartition(v, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(k), (len(v), 1))
            low.sort(axis=1)
            out[at:at + len(v)] = _mix((x[low] * _PICK_MULT[:k]).sum(axis=1, dtype=np.uint64) ^ seeds[:, 0])
        return out.view(np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset: no alignment matches more."""
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def _banded_matches(a: list[int], b: list[int], band: int) -> int:
    """Longest common subsequence among paths that stay within ``band``
    diagonals: a row of the table is a bit string of increments (a clear bit is
    a step up) of which only the band is kept."""
    where: defaultdict[int, list[int]] = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    none: list[int] = []
    low = high = steps = 0
    row, n = 0, len(b)
    for i, x in enumerate(a):
        to = i + band + 1
        if to > n:
            to = n
        if to > high:
            row |= ((1 << (to - high)) - 1) << (high - low)
            high = to
        begin = i - band
        if begin > low:
            if begin > high:
                break
            steps += (begin - low) - (row & ((1 << (begin - low)) - 1)).bit_count()
            row >>= begin - low
            low = begin
        hit = 0
        for j in where.get(x, none):
            if low <= j < high:
                hit |= 1 << (j - low)
        if hit:
            up = row & hit
            row = ((row + up) | (row - up)) & ((1 << (high - low)) - 1)
    return steps + (high - low) - row.bit_count()


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matches over alignment columns; exact where it is ``least`` or more,
    otherwise some number below ``least``."""
    if not len(a) or not len(b):
        return 0.0
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    top = _common(a, b)
    if top < least * (total - top):
        return 0.0
    band = int((1.0 - least) / (1.0 + least) * total) + 1
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    matches = head + tail
    if len(a) and len(b):
        matches += _banded_matches(a.tolist(), b.tolist(), band)
    return matches / (total - matches)


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _sketch_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: _id, _th (hash of the text), node (null without words), sketch."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        maker = Sketcher()
        for batch in batches:
            nodes, values = [], []
            for text in batch.column(2).to_pylist():
                s = maker.shingles(text)
                nodes.append(maker.key(s) if len(s) else None)
                values.append(np.concatenate([maker.sketch(s), maker.short_keys(s)]) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(values, pa.list_(pa.int64()))],
                names=["_id", "_th", "node", "sketch"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), _text_hash(text_col).alias("_th"), F.col(text_col).alias("_text"))
    return stash(rows.mapInArrow(run, f"_id {kind}, _th bigint, node bigint, sketch array<bigint>"), "omh-sketch")


def _sequences(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node -> seq (shingles as 32-bit numbers) of the wanted nodes; ``wanted``
    has node and _id, one row of each node."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        maker = Sketcher()
        for batch in batches:
            found = [maker.shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([maker.key(s) for s in found], pa.int64()),
                 pa.array([(s >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in found],
                          pa.list_(pa.int32()))], names=["node", "seq"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    ids = wanted.select(F.col("_id").alias("_w")).distinct()
    texts = rows.join(ids.hint("merge"), rows["_id"].eqNullSafe(ids["_w"]), "left_semi")
    found = texts.select("_text").mapInArrow(run, "node bigint, seq array<int>")
    # repeated ids may bring other texts or the same one twice
    one = Window.partitionBy("node").orderBy(F.size("seq"))
    return stash(found.join(wanted.select(F.col("node").alias("_wn")), F.col("node") == F.col("_wn"), "left_semi")
                 .withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k"), "omh-seq")


def _verified(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, la, lb: their classes so far) whose alignment reaches ``least``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow as pa
        for batch in batches:
            keep = []
            left, right = batch.column(4), batch.column(5)
            for k in range(batch.num_rows):
                x, y = (c[k].values.to_numpy(zero_copy_only=False) for c in (left, right))
                keep.append(alignment_similarity(x, y, least) >= least)
            yield pa.RecordBatch.from_arrays(
                [pc.filter(batch.column(i), pa.array(keep, pa.bool_())) for i in range(4)], names=["a", "b", "la", "lb"])

    member = seqs.select(F.col("node").alias("_mn"), F.col("seq").alias("_ms"))
    leader = seqs.select(F.col("node").alias("_ln"), F.col("seq").alias("_ls"))
    j = (pairs.join(member.hint("merge"), F.col("b") == F.col("_mn")).select("a", "b", "la", "lb", "_ms")
              .join(leader.hint("merge"), F.col("a") == F.col("_ln")).select("a", "b", "la", "lb", "_ls", "_ms"))
    return stash(j.mapInArrow(run, "a bigint, b bigint, la bigint, lb bigint"), "omh-links")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node in a link."""
    both = stash(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                 .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "omh-edges")
    labels = stash(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), "omh-label")
    while True:
        sent = both.join(labels, both["u"] == labels["node"]).select(
            F.col("v").alias("node"), "label", F.lit(None).cast("bigint").alias("old"))
        near = stash(sent.unionByName(labels.select("node", "label", F.col("label").alias("old")))
                     .groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "omh-label")
        # shortcut: a node takes the label of its label
        far = near.select(F.col("node").alias("_n"), F.col("label").alias("_far"))
        new = stash(near.join(far, near["label"] == far["_n"], "left")
                    .select("node", F.least("label", F.coalesce("_far", "label")).alias("label"), "old"), "omh-label")
        labels = new.select("node", "label")
        if new.where("label <> old").limit(1).count() == 0:
            return labels


def _bitmap(labelled: np.ndarray) -> np.ndarray:
    """Parity of the shingles per bit: two bitmaps differ in no more bits than
    the sets differ in shingles."""
    odd = np.bincount((_mix(labelled) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rest(members: DataFrame, heads: DataFrame, seqs: DataFrame, tested: DataFrame, least: float) -> DataFrame:
    """All links between classes of the buckets that still hold several (``heads``):
    pairs that may reach ``least`` by a prefix filter on the rarest labelled shingles."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            found = [Sketcher.labelled(x.values.to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64))
                     for x in batch.column(2)]
            maps = np.array([_bitmap(x) for x in found], np.int64).reshape(-1, BITMAP)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()),
                 *[pa.array(np.ascontiguousarray(m)) for m in maps.T],
                 pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))],
                names=["node", "label", "size", *bits, "tokens"])

    bits = [f"m{i}" for i in range(BITMAP)]
    nodes = stash(members.join(heads.select("_b").hint("merge"), F.col("bucket") == F.col("_b"), "left_semi")
                  .select(F.col("node").alias("_n"), "label").distinct(), "omh-open")
    whole = stash(seqs.join(nodes.hint("merge"), F.col("node") == F.col("_n")).select("node", "label", "seq").mapInArrow(
        run, "node bigint, label bigint, size bigint, " + "".join(f"{b} bigint, " for b in bits)
        + "tokens array<bigint>"), "omh-whole")
    tokens = whole.select(F.col("node").alias("_n"), F.explode("tokens").alias("token"))
    counts = stash(tokens.groupBy(F.col("token").alias("_t")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "omh-counts")
    # a node's shingles by frequency, the rarest at place 0: those of no other node come before all that are left here
    often = stash(tokens.join(counts.hint("merge"), F.col("token") == F.col("_t")).select("_n", "token", "n"), "omh-often")
    back = F.row_number().over(Window.partitionBy("_n").orderBy(F.desc("n"), F.desc("token")))
    share = least / (1.0 + least)
    first = (often.withColumn("_back", back)
             .join(whole.drop("tokens").hint("merge"), F.col("_n") == F.col("node"))
             .withColumn("place", F.col("size") - F.col("_back"))
             .where(F.col("size") - F.col("place") >= least * F.col("size") - 1e-6)
             .withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
             .select("token", "salts", "node", "label", "size", "place", *bits))
    first = stash(first, "omh-prefix")
    # the shorter one (x) needs fewer shingles than the longer one (y); a shingle of many nodes is dealt by y
    x = (first.where(F.col("size") - F.col("place") >= 2 * share * F.col("size") - 1e-6)
         .select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    y = first.select("*", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    x, y = (d.select(*[F.col(c).alias(f"{side}_{c}") for c in d.columns if c != "salts"])
            for d, side in ((x, "x"), (y, "y")))
    need = share * (F.col("x_size") + F.col("y_size")) - 1e-6
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in bits), F.lit(0))
    pairs = x.join(y.hint("merge"), (F.col("x_token") == F.col("y_token")) & (F.col("x_salt") == F.col("y_salt"))
                   & (F.col("x_label") != F.col("y_label"))
                   & ((F.col("x_size") < F.col("y_size"))
                      | ((F.col("x_size") == F.col("y_size")) & (F.col("x_node") < F.col("y_node"))))
                   & (F.col("x_size") >= least * F.col("y_size") - 1e-6)
                   & (F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place")) >= need)
                   & (apart <= F.col("x_size") + F.col("y_size") - 2 * need))
    pairs = (pairs.groupBy(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))
             .agg(F.first(F.least("x_label", "y_label")).alias("la"), F.first(F.greatest("x_label", "y_label")).alias("lb")))
    old = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    pairs = stash(pairs.join(old.hint("merge"), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"),
                  "omh-pairs")
    return _verified(pairs, seqs, least)


def _relabelled(labels: DataFrame | None, merged: DataFrame) -> DataFrame:
    """node, label after the labels in ``merged`` (node: a label so far, label:
    its new one) have changed; nodes without a class are not listed."""
    if labels is None:
        return merged
    new = merged.select(F.col("node").alias("_l"), F.col("label").alias("_new"))
    every = labels.unionByName(merged.select("node", F.col("node").alias("label")))
    return stash(every.join(new.hint("merge"), F.col("label") == F.col("_l"), "left")
                 .groupBy("node").agg(F.min(F.coalesce("_new", "label")).alias("label")), "omh-label")


def _links(buckets: DataFrame, seqs: DataFrame, least: float) -> DataFrame | None:
    """Labels of the nodes in classes of several nodes, or None without links."""
    labels, tested, turn = None, None, 0
    members = buckets.select("bucket", "node", F.col("node").alias("label"), F.lit(False).alias("linked"))
    while True:
        # the leader of each bucket that holds several classes: nodes without a link
        # first, by one order of all nodes, so that buckets of a group share leaders
        rank = F.xxhash64(F.col("node"), F.lit(turn)) if turn else F.col("node")
        heads = stash(members.groupBy(F.col("bucket").alias("_b"))
                      .agg(F.min(F.struct(F.col("linked"), rank.alias("r"), F.col("node"), F.col("label"))).alias("_h"),
                           F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n"))
                      .where("_lo <> _hi").select("_b", F.col("_h.node").alias("_lead"), F.col("_h.label").alias("_own"), "_n"),
                      "omh-heads")
        largest = heads.agg(F.max("_n")).first()[0]
        if largest is None:
            return labels           # every pair of classes that shares a bucket was tested
        if turn > LEAST_TURNS and (not new or largest <= REST_NODES) or turn > MOST_TURNS:
            break
        # members of the leader's own class meet no one: a class that has formed costs no row
        pairs = (members.join(heads.hint("merge"), (F.col("bucket") == F.col("_b")) & (F.col("label") != F.col("_own")))
                 .groupBy(F.least("_lead", "node").alias("a"), F.greatest("_lead", "node").alias("b"))
                 .agg(F.first(F.least("label", "_own")).alias("la"), F.first(F.greatest("label", "_own")).alias("lb")))
        if tested is not None:
            old = tested.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
            pairs = pairs.join(old, (pairs["a"] == old["_a"]) & (pairs["b"] == old["_b"]), "left_anti")
        pairs = stash(pairs, "omh-pairs")
        found = _verified(pairs, seqs, least)
        new = found.limit(1).count() > 0
        if new:
            labels = _relabelled(labels, components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()))
            at = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            members = stash(buckets.join(at.hint("merge"), buckets["node"] == at["_n"], "left").select(
                "bucket", "node", F.coalesce("_l", "node").alias("label"), F.col("_l").isNotNull().alias("linked")),
                "omh-members")
        pairs = pairs.select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        turn += 1
    found = _rest(members, heads, seqs, tested, least)
    if found.limit(1).count():
        labels = _relabelled(labels, components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()))
    return labels


def _classes(df: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """_id, _th, class_id, class_size, kept per input row."""
    ship(df)
    sketches = _sketch_table(df, id_col, text_col)
    worded = sketches.where(F.col("node").isNotNull())
    nodes = worded.groupBy("node").agg(F.min("_id").alias("_id"), F.first("sketch").alias("sketch"))
    values = stash(nodes.select("node", "_id", F.explode("sketch").alias("bucket")), "omh-values")
    shared = stash(values.groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
                   .where("_n > 1").select("_b"), "omh-shared")
    buckets = stash(values.join(shared.hint("merge"), values["bucket"] == shared["_b"], "left_semi"), "omh-buckets")
    wanted = stash(buckets.select("node", "_id").distinct(), "omh-wanted")
    seqs = _sequences(df, id_col, text_col, wanted)
    labels = _links(buckets.select("bucket", "node"), seqs, similarity)

    rows = worded.select("_id", "_th", "node")
    if labels is None:
        rows = rows.withColumn("class", F.col("node"))
    else:
        at = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        rows = rows.join(at, rows["node"] == at["_n"], "left").select("_id", "_th", "node", F.coalesce("_l", "node").alias("class"))
    rows = stash(rows, "omh-rows")
    # the smallest id names the class; where it stands for several texts, one of them does
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("node")))
    names = stash(rows.groupBy(F.col("class").alias("_c")).agg(first.alias("_f"), F.count(F.lit(1)).alias("class_size")),
                  "omh-names")
    out = rows.join(names, rows["class"] == names["_c"]).select(
        "_id", "_th", F.col("_f.id").alias("class_id"), "class_size",
        (F.col("_id").eqNullSafe(F.col("_f.id")) & (F.col("node") == F.col("_f.node"))).alias("kept"))
    alone = sketches.where(F.col("node").isNull()).select(
        "_id", "_th", F.col("_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, ``class_id``, ``class_size``, ``kept`` (the row
    that stands for its class; rows repeated with one id and text do together)."""
    return _classes(df, id_col, text_col, similarity).select(
        F.col("_id").alias(id_col), "class_id", "class_size", "kept")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stand for their class, with all their columns. A
    row is known by its id and its text's hash: rows that share an id, or have
    none, stay or go by their own text. Only the keys that go are looked up."""
    lost = (_classes(df, id_col, text_col, similarity).where("not kept")
            .select(F.col("_id").alias("_lost_id"), F.col("_th").alias("_lost_text")).distinct())
    mark = "_text_hash"
    while mark in df.columns:
        mark += "_"
    own = [c for c in df.columns if c in ("_lost_id", "_lost_text")]
    rows = df.withColumn(mark, _text_hash(text_col))
    if own:
        lost = lost.withColumnsRenamed({c: f"{c}{mark}" for c in ("_lost_id", "_lost_text")})
    i, t = lost.columns
    return rows.join(lost, rows[id_col].eqNullSafe(lost[i]) & (rows[mark] == lost[t]), "left_anti").drop(mark)
