"""PII: regular expressions propose spans, checksums confirm them, context words adjust the score. DataFrame functions only.

Kinds, in this order: email, ip, card, phone (the base kinds), iban, ssn, secret (added by the method).
A base match that fails its check is dropped; it is not retried at another place. An IBAN has to pass mod-97, and where what follows
it was taken for its end, shorter ends (by one group or by the last few characters) are tried. An SSN-shaped number and a long
hexadecimal or base64 run (a secret) have no checksum, so they count only where a context word lifts their score to the threshold.

Edge cases: null or empty text has no span. Repeated rows are handled row by row. Positions are code points, end exclusive.
Clashing column names: the operator adds `spans` (replacing a column of that name) and keeps every other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]

# The same matches as the published patterns, written so that long runs cost no stack and no quadratic restarts.
# email: an attempt inside a run of local-part characters ends like one at the run's start, so only run starts are tried; \\G
# lets a run that begins where the last match ended be tried as well. ip: likewise for digits. card: the greedy match takes a
# whole run of digits with single separators, so only runs of 12 to 19 digits are matched, from their start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9+/_-]{20,}",
}
# A quick test that every text with a match passes.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]", "secret": "[A-Za-z0-9+/_-]{20}"}
_CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
    "secret": "token|secret|key|apikey|api_key|password|passwd|pwd|auth|bearer|credential|credentials",
}
CONTEXT = {k: f"(?i)(?:^|[^a-z0-9])(?:{w})(?:[^a-z0-9]|$)" for k, w in _CONTEXT_WORDS.items()}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
CONTEXT_BONUS, THRESHOLD, WINDOW = 0.2, 0.5, 40


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97 once its first four characters stand last."""
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(value < 10, (rest * 10 + value) % 97).otherwise((rest * 100 + value) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(9, 15)
    if kind == "iban":
        compact = F.translate(m, " ", "")
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike("[/_-]{3}")
    return F.lit(True)


# What an IBAN's match may have taken too much: nothing, the short last group, or up to two groups of four.
IBAN_ENDS = (r"", r"\x20?[A-Z0-9]{1,3}$", r"\x20?[A-Z0-9]{4}$", r"\x20?[A-Z0-9]{4}\x20?[A-Z0-9]{1,4}$")


def _confirmed(kind: str, m: Column) -> Column:
    """The part of the match that passes its check, or null."""
    if kind != "iban":
        return F.when(_valid(kind, m), m)
    tries = [m if not end else F.regexp_replace(m, end, "") for end in IBAN_ENDS]
    return F.coalesce(*[F.when(_valid(kind, t), t) for t in tries])


def _spans_of(kind: str, text: Column) -> Column:
    """The kind's confirmed spans. The gaps between matches (split) and the matches give every start as a running length."""
    gaps, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))

    def place(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + F.length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["m"].alias("m")))).alias("out"))

    placed = F.aggregate(pairs, start, place, lambda acc: acc["out"])
    part = F.transform(placed, lambda s: F.struct(s["start"].alias("start"), _confirmed(kind, s["m"]).alias("m")))
    kept = F.transform(F.filter(part, lambda s: s["m"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["m"])).alias("end"), s["m"].alias("m")))

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)), F.least(s["start"], F.lit(WINDOW)))
        score = F.lit(BASE_SCORE[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("text"), score.alias("score"))

    spans = F.transform(kept, scored)
    if kind not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,text:string,score:double>>")
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(none)


def find_pii(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """df with `spans`: array of (kind, start, end, text, score) by start, then kind in the order of KINDS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df
    for kind in kinds:
        out = out.withColumn(f"__pii_{kind}", _spans_of(kind, text))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ordered = F.array_sort(
        F.transform(
            F.flatten(F.array(*[F.col(f"__pii_{k}") for k in kinds])),
            lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"), s["score"].alias("score")),
        )
    )
    spans = F.transform(ordered, lambda s: F.struct(s["kind"], s["start"], s["end"], s["text"], s["score"]))
    return out.withColumn("spans", spans).drop(*[f"__pii_{k}" for k in kinds])


def redact(df: DataFrame, text_col: str = "text", min_score: float = THRESHOLD) -> DataFrame:
    """df with `redacted`: each span of at least that score replaced by its kind in brackets; of overlapping spans the first counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        moved = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= acc["at"], moved).otherwise(acc)

    chosen = F.filter("spans", lambda s: s["score"] >= min_score)
    return df.withColumn("redacted", F.aggregate(chosen, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def op2_pii_spans(spark, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, the digest of the base spans and all spans as kind:start:end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("span"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["span"]), ",")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), F.size("s").cast("long").alias("n_spans"))
