"""Awkward rows shared by the operator tests."""

import random

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", _id string, _h string, node string, bucket string, keep_id string, token_ids string, _src string"

WORDS = ("the of and river stone light from under walks between morning letter open window garden "
         "seven yellow quiet never again ship harbour winter cloud market paper music silver").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 400)) if r.random() < 0.5 else "") for _ in range(n))


def awkward_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = prose(5, 20_000)
    rows = [
        (1, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "a"),
        (3, None, "en", "a"), (4, "", None, "b"), (5, "   \n\t ", "de", None), (6, long, "en", "b"),
        (7, "Größe über Straße — naïve café 漢字 😀", "de", "b"), (8, "!!! ??? ...", None, None),
        (None, "a row without an id", "en", "a"), (None, None, None, None),
        (9, "repeated row", "en", "a"), (9, "repeated row", "en", "a"), (10, "x", "en", "c"),
        (11, prose(1, 60), "en", "a"), (12, prose(2, 60), "en", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows=None, extra=True):
    rows = awkward_rows() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, DOC_SCHEMA)
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], DOC_SCHEMA + EXTRA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
