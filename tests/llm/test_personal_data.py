import hashlib
import random
import re
import time

from riskflow.llm import personal_data as pd_
from tests.llm.helpers import DOC_SCHEMA, empty, frame, plain

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 12 <= len(d) <= 19 and _luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def _base(text):
    found = [(m.start(), rank, m.end()) for rank, (kind, p) in enumerate(PATTERNS)
             for m in re.finditer(p, text or "") if _passes(kind, m.group())]
    return [(PATTERNS[rank][0], s, e) for s, rank, e in sorted(found)]


def _texts():
    r = random.Random(4)
    bits = ["@", ".", "a", "b-c", "x_y%", " ", "-", "4111 1111 1111 1111", "4111111111111111", "10.0.0.256", "1.2.3.4.5.6.7.8",
            "+1 (555) 010-9999", "+49 30 1234567", "+", "(", ")", "é", "😀", "1", "23", "4", "5", "me@mail.example.com", "\n",
            "ip ", "card ", "0", "000255", "..", "@@"]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(4000)]


def test_base_spans_match_the_plain_patterns():
    seen = set()
    for t in [*_texts(), "", None, "a@b@c.d", "@a.b@c.d", "a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5", "+12345678 9 +1"]:
        got = [(k, s, e) for k, s, e, _ in pd_.scan(t) if k in pd_.BASE]
        assert got == _base(t), t
        seen |= {k for k, _, _ in got}
    assert seen == set(pd_.BASE)


def test_digests_on_awkward_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(_texts()[:300])]
    rows += [(None, "me@a.bc", None, None, None), (5, None, None, None, None), (5, "", None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    cols = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for i, t, *_ in rows:
        b = _base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append((i, *[sum(k == x for k, _, _ in b) for x in pd_.BASE], hashlib.sha256(joined.encode()).hexdigest()))
    found = pd_.find_personal_data(df)
    assert plain(pd_.digests(found), *cols) == sorted(want, key=repr)
    whole = {r.doc_id: r.spans for r in pd_.digests(found).where("doc_id > 5").collect()}
    assert whole[10] == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pd_.scan(dict((r[0], r[1]) for r in rows)[10]))
    assert pd_.digests(pd_.find_personal_data(frame(spark))).count() == frame(spark).count()
    assert pd_.digests(pd_.find_personal_data(empty(spark))).count() == 0


def _kinds(text):
    return {k for k, *_ in pd_.scan(text)}


def test_checksums_confirm_and_context_decides():
    assert _kinds("pay to DE89 3704 0044 0532 0130 00 today") == {"iban"}
    assert _kinds("pay to DE88 3704 0044 0532 0130 00 today") == set()
    assert "iban" in _kinds("GB82WEST12345698765432,") and "iban" not in _kinds("GB82WEST123456987654321")
    assert _kinds("my SSN is 123-45-6789.") == {"ssn"} and _kinds("part 123-45-6789.") == set()
    assert _kinds("SSN 000-45-6789") == set() and _kinds("ssn 923-45-6789") == set()
    assert _kinds("bank routing 021000021") == {"routing"} and _kinds("bank routing 021000022") == set()
    assert _kinds("call 555-123-4567 now") == {"local"} and _kinds("555-123-4567") == set()
    score = {k: v for k, _, _, v in pd_.scan("card 4111111111111111")}
    assert score["card"] == 1.0
    assert dict((k, v) for k, _, _, v in pd_.scan("order 4111111111111111"))["card"] == 0.3


def test_redact(spark):
    df = spark.createDataFrame([(1, "write me@a.bc or +49 30 1234567!", "en", "s", None), (2, None, None, None, None),
                                (3, "clean", "en", "s", None)], DOC_SCHEMA)
    assert plain(pd_.redact(df), "doc_id", "text") == [(1, "write <EMAIL> or <PHONE>!"), (2, None), (3, "clean")]


def test_long_runs_take_time_in_proportion():
    for unit in ("a", "a.", "1", "1.", "1 ", "+1", "@", "a@", "a@b", "+1 ", "(", "A1"):
        text = unit * (2_000_000 // len(unit))
        began = time.time()
        pd_.scan(text)
        assert time.time() - began < 12, unit
