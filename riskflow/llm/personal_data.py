"""Personal data: patterns propose, checksums confirm, context adjusts the score.

1. Patterns propose spans of each kind, leftmost and without overlap. They are
   written so that a text is scanned once however long its runs are: a run that
   cannot match is passed as a whole.
2. Validators confirm them: an address part is at most 255, a card number passes
   Luhn, an IBAN has its country's length and leaves 1 modulo 97, a bank routing
   number passes its 3-7-1 sum, a social security number has no void group.
   A proposal that fails is dropped.
3. A span's score is what its kind is worth by itself, plus ``HELP`` where a word
   of its context stands within ``NEAR`` code points before or after it, less
   ``HARM`` where a word does that speaks against it (0 to 1).

The base kinds (email, ip, card, phone) stay whatever their score; the kinds
that the method adds (iban, ssn, routing, local phone) need ``LEAST``, which the
number forms without a strong checksum reach by context only.

Positions are code points, ends exclusive. Rows are scanned where they lie;
there is no shuffle.

Defined cases: a null text is empty and has no span. Repeated rows are scanned
each. Only id and text are read, so other columns may have any name. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.llm.common import ship

__all__ = ["find_personal_data", "redact", "digests", "scan"]

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "routing", "local")
KINDS = BASE + ADDED

NEAR = 40
HELP, HARM, LEAST = 0.4, 0.3, 0.6
# what a confirmed span of a kind is worth before its context is read
WORTH = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "routing": 0.2, "local": 0.3}
CONTEXT = {
    "email": r"e-?mail|contact|write|mailto|reply", "ip": r"ip|address|host|server|login|client",
    "card": r"card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|telephone|mobile|cell|call|fax|telefon|téléphone|teléfono",
    "iban": r"iban|account|konto|compte|cuenta|bank", "ssn": r"ssn|social security|social",
    "routing": r"routing|aba|transit|bank", "local": r"phone|tel|telephone|mobile|cell|call|fax"}
AGAINST = r"version|release|isbn|issn|order|invoice|ticket|serial|sku|chapter"

# Lengths of international bank account numbers by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TR": 26, "AE": 23, "IL": 23, "SA": 24}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match may begin only where a group of digits does: one that began inside could have begun there
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ROUTING = re.compile(r"(?<![0-9A-Za-z-])[0-9]{9}(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_HELPS = {k: re.compile(rf"(?<!\w)(?:{w})(?!\w)") for k, w in CONTEXT.items()}
_HARMS = re.compile(rf"(?<!\w)(?:{AGAINST})(?!\w)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(c if c.isdigit() else str(ord(c) - 55) for c in turned)) % 97 == 1


def _emails(text: str):
    """Every ``@`` with a domain, and the local part that runs up to it. No run
    holds two ``@``, so a local part begins after the one before or after the
    match before."""
    begin = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        begin = max(begin, text.rfind("@", begin, at) + 1)
        head = text[begin:at]
        size = len(head) - len(head.rstrip(_LOCAL))
        if size:
            yield at - size, m.end()
            begin = m.end()
        else:
            begin = at + 1


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    end = 0
    for m in _IBAN.finditer(text):
        size, start = IBAN_LENGTH.get(text[m.start():m.start() + 2]), m.start()
        if size is None or start < end:
            continue
        at, found = start, []
        while len(found) < size and at < len(text):
            c = text[at]
            if "0" <= c <= "9" or "A" <= c <= "Z":
                found.append(c)
            elif c != " " or text[at - 1] == " ":
                break
            at += 1
        if len(found) == size and not (at < len(text) and text[at].isalnum()) and mod97("".join(found)):
            end = at
            yield start, at


def _ssns(text: str):
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield m.span()


def _routings(text: str):
    for m in _ROUTING.finditer(text):
        d = [ord(c) - 48 for c in m.group()]
        if any(d) and (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0:
            yield m.span()


def _local_phones(text: str):
    for m in _LOCAL_PHONE.finditer(text):
        yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns,
         "routing": _routings, "local": _local_phones}


def _score(text: str, kind: str, start: int, end: int) -> float:
    before, after = text[max(0, start - NEAR):start].lower(), text[end:end + NEAR].lower()
    score = WORTH[kind]
    if _HELPS[kind].search(before) or _HELPS[kind].search(after):
        score += HELP
    if _HARMS.search(before):
        score -= HARM
    return round(min(1.0, max(0.0, score)), 6)


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text's spans by start, then by kind as listed."""
    if not text:
        return []
    found = []
    digits = _DIGIT.search(text) is not None
    for rank, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind != "email" and not digits:
            continue
        for start, end in _FIND[kind](text):
            score = _score(text, kind, start, end)
            if rank < len(BASE) or score >= LEAST:
                found.append((start, rank, end, score))
    return [(KINDS[rank], start, end, score) for start, rank, end, score in sorted(found)]


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of kind, start, end, score."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("score", pa.float64())]))
        for batch in batches:
            texts = batch.column(1)
            found = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in scan(texts[i].as_py())]
                     for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id_col, "spans"])

    ship(df)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(df: DataFrame, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``df`` with every span of ``least`` or more in ``text_col`` replaced by its
    kind in angle brackets; of spans that overlap the first names what they
    cover together. Null stays null."""
    @F.pandas_udf("string")
    def mask(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            joined = []
            for kind, start, end, score in scan(text):
                if score < least:
                    continue
                if joined and start < joined[-1][2]:
                    joined[-1][2] = max(joined[-1][2], end)
                else:
                    joined.append([kind, start, end])
            for kind, start, end in joined:
                out += [text[at:start], f"<{kind.upper()}>"]
                at = end
            return "".join([*out, text[at:]])
        return texts.map(one)

    ship(df)
    return df.withColumn(text_col, mask(F.col(text_col)))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``find_personal_data``'s rows as counts of the base kinds, a digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(id_col, *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"),
                        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"))
