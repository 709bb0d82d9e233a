"""Fill-in-middle transformation of whole texts, cut at line borders.

1. A unit is a line with its line feed; what follows the last line feed is a
   unit if it is not empty. Two numbers from a hash of seed and id, taken modulo
   units + 1, name the units after which the prefix and the middle end.
2. The UTF-8 text is seen as fixed blocks of ``BLOCK`` bytes. A Fenwick tree over
   the blocks holds how many units end and how many code points begin in each.
   A cut is found by binary-lifting descent to its block, adding up the code
   points passed, and by locating the line feed inside that one block.
3. Form ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is
   ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; a ``plain`` text stays as it is.
   The parts hold no marker, and a marker begins with the only ``<`` in it, so
   the three markers split the output again without doubt: ``restore`` rebuilds
   the text from output and form alone, with built-in functions.

Rows are transformed where they lie; there is no shuffle.

Defined cases: a null text is empty and an empty text is plain with 0 units; a
text that holds one of the markers is plain; a null id hashes as an empty one.
Rows with one id are cut by the same numbers, each by its own units. Only id and
text are read, so other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship

__all__ = ["fill_in_middle", "restore", "digests", "BlockTree"]

# The markers, the seed of the cuts, the share of texts transformed
# and the share of spm among them (in percent).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
RATE = 100
SPM_RATE = 50

BLOCK = 4096          # bytes of a block
_SLICE = 16 << 20     # bytes of text that are put together at once


class BlockTree:
    """Units ended and code points begun per block of a UTF-8 text, as a Fenwick tree."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.block = block
        self.bytes = np.frombuffer(text, np.uint8)
        m = -(-len(text) // block)
        units, points = [0] * (m + 1), [0] * (m + 1)
        for i in range(m):
            part = self.bytes[i * block:(i + 1) * block]
            units[i + 1] += int(np.count_nonzero(part == 10))
            points[i + 1] += self._points(part)
            up = i + 1 + ((i + 1) & -(i + 1))
            if up <= m:
                units[up] += units[i + 1]
                points[up] += points[i + 1]
        self.units, self.points = units, points
        self.ended = self._total(units)
        self.code_points = self._total(points)
        self.n = self.ended + (1 if text and text[-1] != 10 else 0)

    @staticmethod
    def _points(part: np.ndarray) -> int:
        return int(np.count_nonzero((part & 0xC0) != 0x80))

    @staticmethod
    def _total(tree: list[int]) -> int:
        i, total = len(tree) - 1, 0
        while i > 0:
            total += tree[i]
            i &= i - 1
        return total

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the text's first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units > self.ended:
            return len(self.bytes), self.code_points
        at = points = 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            to = at + step
            if to < len(self.units) and self.units[to] < units:
                at = to
                units -= self.units[to]
                points += self.points[to]
            step >>= 1
        part = self.bytes[at * self.block:(at + 1) * self.block]
        end = int(np.flatnonzero(part == 10)[units - 1]) + 1
        return at * self.block + end, points + self._points(part[:end])


def _draws(seed: int, key: str) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(text: bytes, key: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE):
    """(units, form, output, prefix code points, middle code points) of one text."""
    tree = BlockTree(text)
    h1, h2, h3, h4 = _draws(seed, key)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return tree.n, "plain", text, None, None
    first, second = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    a, a_points = tree.cut(first)
    b, b_points = tree.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        form, out = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, out = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return tree.n, form, out, a_points, b_points - a_points


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per input row: id, ``n`` units, ``form``, ``output``, ``prefix_chars``, ``middle_chars``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        names = [id_col, "n", "form", "output", "prefix_chars", "middle_chars"]

        def rows(ids, done):
            n, form, out, a, b = zip(*done)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(out, pa.binary()).cast(pa.string()),
                 pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
            done, begin, held = [], 0, 0
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                done.append(transform(text, keys[k].as_py(), seed, rate, spm_rate))
                held += len(text)
                if held > _SLICE:
                    yield rows(ids.slice(begin, len(done)), done)
                    done, begin, held = [], k + 1, 0
            if done:
                yield rows(ids.slice(begin, len(done)), done)

    ship(df)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, n bigint, form string, output string, prefix_chars bigint, middle_chars bigint")


def restore(output: Column, form: Column) -> Column:
    """The text, from a row's output and form."""
    part = F.split(output, "<[PSM]>")
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(part[1], part[3], part[2]))
            .otherwise(F.concat(part[2], part[3], part[1])))


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``fill_in_middle``'s rows with SHA-256 of the output and of the restored text instead of the output."""
    return done.select(id_col, "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
