import hashlib
import re

from fieldtopo.llm import pii

from .helpers import empty, frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TEXTS = [
    None,
    "",
    "write to ann.b+c@example.org_x@y.org and a@b, a@b., @c.d",
    "é1.2.3.4.5 256.1.1.1 001.002.003.255 1.2.3 1...2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111110000 5500 0000 0000 0004 7",
    "call +49 (30) 123-456.78 or +1 2 or ++4912345678901 or +1234567890123456",
    "naïve 🙂 4111111111111111 x@y.zz +441234567890",
    "a" * 50_000 + "@" + "b." * 100 + "c" + "1" * 50_000,
    "1 2" * 3000,
    "1." * 20_000,
    "+" * 2000 + "1" + " " * 20_000,
]


def test_base_spans_equal_plain_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_pii(df, kinds=pii.BASE_KINDS).collect()}
    for i, text in enumerate(TEXTS):
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in got[i]) == plain(text), i
        assert all((text or "")[s.start : s.end] == s.text for s in got[i])


def test_checksums_and_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32 ok", "GB82WEST12345698765433", "my ssn is 123-45-6789", "order 123-45-6789", "visa card 4111111111111111", "4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert ("iban", 1.0) in got[0] and not any(k == "iban" for k, _ in got[1])
    assert got[2] == [("ssn", 0.5)] and got[3] == []
    assert got[4] == [("card", 1.0)] and got[5] == [("card", 0.8)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None)], "doc_id long, text string")
    assert [r.redacted for r in pii.redact(pii.find_pii(df)).orderBy("doc_id").collect()] == ["mail [email] now", ""]


def test_awkward_rows_and_empty_table(spark):
    df = frame(spark)
    got = pii.find_pii(df)
    assert got.count() == df.count() and "extra" in got.columns
    assert pii.find_pii(empty(spark)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_iban_ends_and_credentials(spark):
    key = "e7fbfec6a80404dc513b99d3fdbf12ab"
    texts = ["ES91 2100 0418 4502 0005 1332 PAID by bank", "GB82 WEST 1234 5698 7654 32 AND MORE", f'token = "{key}"', f"commit {key}", "the api_key: " + "abcdefghijklmnopqrstuvwxyz", "ES91 2100 0418 4502 0005 1333 PAID"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.text) for s in r.spans if s.kind in ("iban", "secret")] for r in pii.find_pii(df).collect()}
    assert got[0] == [("iban", "ES91 2100 0418 4502 0005 1332")] and got[1] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert got[2] == [("secret", key)] and got[3] == got[4] == got[5] == []
