"""Secret scan by patterns and a randomness test battery (DataFrame functions only).

Patterns give the base spans. The battery adds tokens that no pattern names:
maximal runs of encoding characters whose encoding can be inferred (hex,
base32, base36, BASE36, base64, base64url) are tested against "characters drawn
uniformly and independently from that alphabet" by
  * a chi-squared test of the alphabet's uniformity,
  * a runs test about the middle of the alphabet,
  * a lag-1 serial correlation test,
combined by Fisher's method. Ordinary identifiers are rejected by these tests.
``=`` only ends a run, so a name and its value are two. A run that is in no
encoding as a whole is split at the characters that base64, base64url or the
plain alphabets do not hold, and its parts that are in an encoding and within no
other such part are tested.
A Benjamini-Hochberg step-up at level ``q`` inside each stratum of encoding and
length (long tokens carry far more evidence than short ones, so they are not
ranked together) decides which rejections count: at most a share ``q`` of the
tokens thrown away may be truly random. What is left is reported.

The step-up needs ranks over all tokens of the corpus. P-values are rounded up
to bins, counts per bin are aggregated map-side, and the threshold per stratum
comes from a running sum over at most a few thousand bins: exact for the
rounded values, with nothing gathered. Texts are read once; the scan without
texts is written to the shared folder, and so are the tested tokens, a row each,
before the thresholds are applied.

Spans are in code points, end exclusive; ``a:b:c`` is kind, start, end. A span's
extent is the whole match. Defined cases: a null text is empty and has no
spans; ties of start are ordered by kind as listed; repeated rows give equal
results; only id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import stash

__all__ = ["scan", "find_secrets", "KINDS"]

# Fixed values of the task: kinds in order, their patterns and least lengths.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
# a run shorter than 24 fails, and a run of 24 or more is matched whole either way
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Parameters of the battery.
TOKEN = r"[A-Za-z0-9+/_-]{20,}=*"
PARTS = (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")
LEVEL = 0.05
BIN = 20.0  # bins per factor e of a p-value
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix(x: Column) -> Column:
    """[0, x1, x1+x2, ...]: one element more than ``x``; for short arrays."""
    return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))


def _starts(lengths: Column) -> Column:
    """Sums of the lengths before each element, block by block so that a text
    with very many matches stays cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / _BLOCK).cast("int") - 1),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, v: a + v)

    def spread(z):
        return F.flatten(F.transform(z["blocks"], lambda x, b: F.transform(
            F.slice(_prefix(x), 1, F.size(x)), lambda v: v + z["offsets"][b])))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(
        _let(blocks, lambda bs: _let(F.struct(bs.alias("blocks"), _prefix(F.transform(bs, total)).alias("offsets")),
                                     spread)))


def _located(text: Column, pattern: str, matches: Column) -> Column:
    """array<struct<start, end, text>> of the matches of ``pattern``."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.length(m).alias("n")))

    def place(z):
        lens = F.zip_with(z["g"], z["p"], lambda g, p: g + F.coalesce(p["n"], F.lit(0)))
        return _let(_starts(lens), lambda at: F.transform(z["p"], lambda p, i: F.struct(
            (at[i] + z["g"][i]).alias("start"), (at[i] + z["g"][i] + p["n"]).alias("end"), p["m"].alias("text"))))

    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(F.size(matches) == 0, empty).otherwise(
        _let(F.struct(gaps.alias("g"), parts.alias("p")), place))


def _plain(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                 s["end"].alias("end")))


def _encoding(t: Column) -> Column:
    """The encoding a token may be written in, or null."""
    def has(*classes):
        cond = F.lit(True)
        for c in classes:
            cond = cond & t.rlike(c)
        return cond

    return (F.when(has("^[0-9a-f]+$", "[0-9]", "[a-f]"), "hex")
             .when(has("^[0-9A-F]+$", "[0-9]", "[A-F]"), "HEX")
             .when(has("^[A-Z2-7]+$", "[A-Z]", "[2-7]"), "base32")
             .when(has("^[0-9a-z]+$", "[0-9].*[0-9]", "[a-z]"), "base36")
             .when(has("^[0-9A-Z]+$", "[0-9].*[0-9]", "[A-Z]"), "BASE36")
             .when(has("^[A-Za-z0-9+/]+$", "[A-Z]", "[a-z]", "[0-9]"), "base64")
             .when(has("^[A-Za-z0-9_-]+$", "[A-Z]", "[a-z]", "[0-9]"), "base64url"))


def _candidates(run: Column) -> Column:
    """The run itself if it is in an encoding, else its parts that are; ``k`` is the number of the parts' pattern."""
    whole = F.struct(run["start"].alias("start"), run["end"].alias("end"), run["text"].alias("text"),
                     _encoding(run["text"]).alias("enc"), F.lit(0).alias("k"))

    def parts(k):
        found = _located(run["text"], PARTS[k], F.regexp_extract_all(run["text"], F.lit(PARTS[k]), F.lit(0)))
        return F.transform(found, lambda p: F.struct(
            (run["start"] + p["start"]).alias("start"),
            # the padding belongs to the last part
            F.when(p["end"] == F.length(run["text"]), run["end"]).otherwise(run["start"] + p["end"]).alias("end"),
            p["text"].alias("text"), _encoding(p["text"]).alias("enc"), F.lit(k).alias("k")))

    split = F.filter(F.concat(*map(parts, range(len(PARTS)))), lambda p: p["enc"].isNotNull())
    return _let(whole, lambda w: F.when(w["enc"].isNotNull(), F.array(w)).otherwise(split))


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (a published rational
    approximation, absolute error below 2e-7; fixed coefficients)."""
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _floor_p(p: Column) -> Column:
    return F.greatest(F.lit(1e-15), F.least(F.lit(1.0), p))


def battery(token: Column, encoding: Column) -> Column:
    """Fisher's combined p-value of the three tests for a token in its encoding."""
    alphabet = F.lit(None).cast("string")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(encoding == name, F.lit(letters)).otherwise(alphabet)
    root2 = 2.0 ** 0.5

    def total(xs):
        return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)

    def tests(z):
        x, size = z["x"], z["a"].cast("double")
        n = F.size(x).cast("double")
        counts = F.transform(F.sequence(F.lit(0), z["a"] - 1),
                             lambda k: F.size(F.filter(x, lambda v: v == k)).cast("double"))
        chi = total(F.transform(counts, lambda c: c * c)) * size / n - n
        df = size - 1.0
        zc = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1.0 / 3)) - (1.0 - 2.0 / (9.0 * df))) \
            / F.sqrt(2.0 / (9.0 * df))
        tail = _erfc(F.abs(zc) / root2) / 2.0
        p_chi = F.when(zc >= 0, tail).otherwise(1.0 - tail)

        left, right = F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1)
        half = z["a"] / 2
        n1 = total(F.transform(x, lambda v: F.when(v >= half, 1.0).otherwise(0.0)))
        n2 = n - n1
        runs = 1.0 + total(F.zip_with(left, right, lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0)))
        both = 2.0 * n1 * n2
        var = both * (both - n) / (n * n * (n - 1.0))
        p_runs = F.when(var > 0, _erfc(F.abs(runs - both / n - 1.0) / F.sqrt(F.greatest(var, F.lit(1e-9))) / root2)) \
                  .otherwise(F.lit(1e-15))

        mean = total(F.transform(x, lambda v: v.cast("double"))) / n
        spread = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
        cov = total(F.zip_with(left, right, lambda a, b: (a - mean) * (b - mean)))
        p_ser = F.when(spread > 0, _erfc(F.abs(cov) / F.greatest(spread, F.lit(1e-9)) * F.sqrt(n) / root2)) \
                 .otherwise(F.lit(1e-15))

        h = -(F.log(_floor_p(p_chi)) + F.log(_floor_p(p_runs)) + F.log(_floor_p(p_ser)))
        return F.exp(-h) * (1.0 + h + h * h / 2.0)

    index = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
    return _let(F.struct(index.alias("x"), F.length(alphabet).alias("a")), tests)


def _found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, ``assign``, ``access``, ``hex`` (arrays of struct<start,
    kind, end>) and ``runs``: maximal runs of encoding characters with start, end and text."""
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    found = rows.select(
        "_id", "_text",
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("_m1"),
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("_v1"),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)).alias("_m2"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("_m3"),
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("_m4"))
    placed = found.select(
        "_id", "_v1", _located(text, ASSIGN, F.col("_m1")).alias("_s1"),
        _located(text, ACCESS, F.col("_m2")).alias("_s2"), _located(text, HEX, F.col("_m3")).alias("_s3"),
        _located(text, TOKEN, F.col("_m4")).alias("_s4"))
    return placed.select(
        "_id",
        _plain(F.filter("_s1", lambda s, i: F.length(F.col("_v1")[i]) >= ASSIGN_LEAST), "assign").alias("assign"),
        _plain(F.filter("_s2", lambda s: F.length(s["text"]) >= ACCESS_LEAST), "access").alias("access"),
        _plain(F.col("_s3"), "hex").alias("hex"), F.transform("_s4", lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.rtrim(s["text"], F.lit("=")).alias("text"))).alias("runs"))


def candidates(scanned: DataFrame) -> DataFrame:
    """A row per token to test: ``_row``, start, end, text and enc. ``scanned`` is
    a scan with a ``_row`` for each of its rows.

    Tokens within another one and tokens that overlap a base span go. Both are
    found by one running maximum of the ends in the order of starts, so the work
    follows the number of spans also in a text that has very many."""
    tokens = (scanned.select("_row", F.explode("runs").alias("run"))
              .select("_row", F.col("run.start").alias("_run"), F.explode(_candidates(F.col("run"))).alias("t"))
              .select("_row", "_run", "t.*"))
    inside = (Window.partitionBy("_row", "_run").orderBy("start", F.col("end").desc(), "k")
              .rowsBetween(Window.unboundedPreceding, -1))
    tokens = (tokens.withColumn("_upto", F.max("end").over(inside))
              .where((F.coalesce("_upto", F.lit(-1)) < F.col("end")) & (F.length("text") >= 20)))
    spans = scanned.select("_row", F.explode(F.concat("assign", "access", "hex")).alias("s")).select(
        "_row", F.col("s.start").alias("_at"), F.lit(1).alias("_base"), F.col("s.end").alias("_upto"),
        *[F.lit(None).cast(k).alias(c) for c, k in (("start", "int"), ("end", "int"), ("text", "string"), ("enc", "string"))])
    both = spans.unionByName(tokens.select(
        "_row", F.col("end").alias("_at"), F.lit(0).alias("_base"), F.lit(None).cast("int").alias("_upto"),
        "start", "end", "text", "enc"))
    # base spans that start before the token ends: the furthest of their ends
    before = (Window.partitionBy("_row").orderBy("_at", "_base")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.withColumn("_reach", F.max("_upto").over(before))
            .where((F.col("_base") == 0) & (F.coalesce("_reach", F.lit(-1)) <= F.col("start")))
            .select("_row", "start", "end", "text", "enc"))


def tested(tokens: DataFrame) -> DataFrame:
    """``_row``, start, end, enc, ``band`` (lengths that double share a stratum) and ``bin`` of the p-value.
    Tokens are dealt anew, so one text's tokens are tested by many tasks."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.repartition(parts, "_row", "start").select(
        "_row", "start", "end", "enc", F.floor(F.log2(F.length("text").cast("double"))).cast("int").alias("band"),
        F.floor(-F.log(F.greatest(battery(F.col("text"), F.col("enc")), F.lit(1e-300))) * BIN).cast("int").alias("bin"))


def _scanned(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with base spans, and the tested tokens of all rows, both written."""
    rows = stash(_found(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "secret-scan")
    return rows.drop("runs"), stash(tested(candidates(rows)), "secret-tokens")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``assign``, ``access``, ``hex`` (arrays of struct<start,
    kind, end>) and ``tokens``: candidates outside the base spans with
    encoding, length and p-value."""
    rows, tokens = _scanned(df, id_col, text_col)
    kind = "array<struct<start:int,end:int,enc:string,band:int,bin:int>>"
    found = tokens.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "enc", "band", "bin")))
                                       .alias("tokens"))
    return (rows.join(found, "_row", "left").drop("_row")
            .withColumn("tokens", F.coalesce("tokens", F.array().cast(kind))))


def thresholds(tokens: DataFrame, q: float = LEVEL) -> DataFrame:
    """Per stratum (``enc``, ``band``) the first bin whose tokens are rejected
    as not random; strata without a rejection are missing."""
    counts = tokens.groupBy("enc", "band", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = (Window.partitionBy("enc", "band").orderBy(F.col("bin").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("*", F.sum("n").over(down).alias("upto"),
                           F.sum("n").over(Window.partitionBy("enc", "band")).alias("m"))
    return (counts.where(F.exp(-F.col("bin") / BIN) <= F.lit(q) * F.col("upto") / F.col("m"))
            .groupBy("enc", "band").agg(F.min("bin").alias("least")))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = LEVEL) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    rows, tokens = _scanned(df, id_col, text_col)
    # one row: at most one entry per encoding and power of two of a length
    limit = thresholds(tokens, q).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "enc", F.col("band").cast("string")), "least")))).scalar()
    kept = tokens.withColumn("_least", F.try_element_at(limit, F.concat_ws(":", "enc", F.col("band").cast("string"))))
    kept = kept.where(F.coalesce(F.col("bin") < F.col("_least"), F.lit(True))).groupBy("_row").agg(F.collect_list(
        F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")).alias("random"))

    def joined(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
            ":", F.array(*[F.lit(k) for k in KINDS])[s["kind"]], s["start"].cast("string"),
            s["end"].cast("string"))), ",")

    out = rows.join(kept, "_row", "left").withColumn("random", F.coalesce(
        "random", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    base = F.concat("assign", "access", "hex")
    return out.select(
        F.col("_id").alias(id_col), F.size("assign").cast("bigint").alias("n_assign"),
        F.size("access").cast("bigint").alias("n_access"), F.size("hex").cast("bigint").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("random"))).alias("spans"), F.size("random").cast("bigint").alias("n_random"))
