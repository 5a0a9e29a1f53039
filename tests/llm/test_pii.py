import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tarnflow.llm.pii import BASE_KINDS, joined, mod97_ok, op1_pii, redact, with_spans

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits or "0"),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "a@b.c.d+x@y.z @ a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.256 001.2.3.4", "+1 (017) 555-7713+2 33333333 +1 2",
    "4111 1111 1111 1111 0", "4111-1111-1111-1111", "é😀 4111111111111111 x@y.zz", "4111111111111112", "4111111111111111 é " * 50,
    "a." * 300 + "@b.c", "1 " * 300, "+" * 20 + "1" * 30, "x@y", "9" * 40, "4111  1111 1111 1111",
]


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: r for r in with_spans(df).collect()}
    for i, t in enumerate(TEXTS):
        assert [(s.kind, s.start, s.end) for s in rows[i].pii if s.kind in BASE_KINDS] == brute(t), t


def test_added_kinds_need_checksum_or_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 .", "GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "no 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.pii] for r in with_spans(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["secret"], 5: []}
    scores = {r.doc_id: r.pii[0].score for r in with_spans(spark.createDataFrame([(0, "call me: +1 234 567 8901"), (1, "xx +1 234 567 8901")], "doc_id long, text string")).collect()}
    assert scores[0] > scores[1]


def test_mod97(spark):
    df = spark.createDataFrame([("DE89370400440532013000", True), ("DE89370400440532013001", False)], "c string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(mod97_ok(df.c), "ok").collect())


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz and 1.2.3.4!"), (2, None), (3, "clean"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact(df).collect()} == {1: "mail <EMAIL> and <IP>!", 2: None, 3: "clean", 4: ""}


def plain_redaction(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], f"<{kind.upper()}>"]
            at = end
    return "".join(out) + text[at:]


def test_texts_with_very_many_matches(spark):
    many = " ".join(f"a{i}@b.cc é +1 234 567 {1000 + i % 9000}" for i in range(4000))
    texts = [many, "x@y.zz " * 128, "x@y.zz " * 129, "+1.2.3.4 5678 90 " * 300, " 1.2.3.4@x.yy,1.2.3.4" * 140]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in with_spans(df).collect()}
    out = {r.doc_id: r.text for r in redact(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in found[i] if s[0] in BASE_KINDS] == brute(t)
        assert out[i] == plain_redaction(t, [(a, b, k) for k, a, b in found[i]])


def test_work_grows_with_the_matches(spark):
    import time

    df = spark.createDataFrame([(1, "name@host.org " * 32_000)], "doc_id long, text string")
    began = time.time()
    assert with_spans(df).select(F.size("pii")).first()[0] == 32_000 and redact(df).first().text == "<EMAIL> " * 32_000
    assert time.time() - began < 30


def test_extra_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x@y.zz", "a"), (1, "x@y.zz", "a")], "doc_id long, text string, pii string")
    assert [len(r.pii) for r in with_spans(df).collect()] == [1, 1]
    assert with_spans(df.limit(0)).count() == 0 and redact(df.limit(0)).count() == 0


@pytest.fixture
def folder(tmp_path, spark):
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query(spark, folder):
    for r in op1_pii(spark, folder).collect():
        spans = brute(TEXTS[r.doc_id])
        text = ",".join("%s:%d:%d" % s for s in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE_KINDS]
    assert joined is not None
