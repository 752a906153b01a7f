"""WARC derivatives: every response record yields a linked metadata record and a plain-text conversion record.

Both carry WARC-Refers-To (the response's record id), the source's target URI and date, their own block digest and, in the
metadata block, the response's own digests and every line of its HTTP head (`source-http: ...`), so that each derivative leads back
to the bytes it was made from. DataFrame functions only; one projection and one explode, no shuffle.

Text. Elements that hold no text (script and its like) and comments go, block ends become line ends, tags go (a `>` within a
quoted attribute does not end one; a `<` that no letter follows is text), then references to characters are resolved, those of
ENTITIES and all numeric ones, and white space is collapsed.

Record ids are name-based (from the source's id, address and payload and the kind), so a rerun writes the same ids, and pages that
share an id and differ in anything have ids of their own. Digests are `sha1:` with lowercase hexadecimal digits. Lines end in
CRLF; a record ends in two. `write_records` and `read_records` keep records as WARC files.

Edge cases: null html is an empty payload, null url an empty target URI; both records are still made. Repeated equal rows give
repeated equal records. Pages may bring `http` (the head as it came) and `date`; where they do not, a plain head and DATE stand for
them. Extra columns are not carried: the records are the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
_SILENT, _BLOCK_ENDS = ("script", "style", "noscript", "template"), "br|/p|/div|/h[1-6]|/li|/tr|/title|/section|/article"


def tag_rules(attributes: str) -> list[tuple[str, str]]:
    """(pattern, replacement) in turn, by the pattern of a tag's inside."""
    silent = "|".join(f"{name}\\b[^>]*>.*?</{name}" for name in _SILENT)
    return [
        (f"(?is)<(?:{silent})\\s*>", " "),
        (r"(?s)<!--.*?-->", " "),
        (f"(?i)<(?:{_BLOCK_ENDS})\\b{attributes}>", "\n"),
        (f"</?[a-zA-Z]{attributes}>|<[!?][^>]*>", " "),
        (r"</?[a-zA-Z][^<>]*>", " "),  # tags with an odd quote
    ]


# The inside of a tag: what is not quoted, or quoted by either mark. Possessive, so that long ones cost no stack; the choice is definite.
INSIDE = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
SPACE_RULES = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]
# Named references and their characters; `amp` comes last, as its result must not be read again.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™", "deg": "°",
    "middot": "·", "bull": "•", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "sect": "§",
    "times": "×", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü",
    "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ", "amp": "&",
}
NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"


def _numeric(text: Column) -> Column:
    """Numeric references as characters; numbers that are none give U+FFFD."""
    found, gaps = F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0)), F.split(text, NUMERIC, -1)

    def one(ref: Column) -> Column:
        body = F.substring(ref, F.lit(3), F.length(ref) - 3)
        hexadecimal = F.lower(F.substring(body, 1, 1)) == "x"
        code = F.when(hexadecimal, F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).cast("int")
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        plain = F.when(code == 160, F.lit(" ")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(real, plain).otherwise(F.lit("�"))

    return F.array_join(F.flatten(F.zip_with(gaps, F.transform(found, one), lambda g, c: F.array(g, F.coalesce(c, F.lit(""))))), "")


def with_text(df: DataFrame, html_col: str, name: str) -> DataFrame:
    """df with the plain text of its HTML in a column of that name. By steps, as each is looked at more than once."""
    text = F.col(html_col)
    for pattern, by in tag_rules(INSIDE):
        text = F.regexp_replace(text, pattern, by)
    df = df.withColumn(name, text)
    df = df.withColumn(name, F.when(F.contains(F.col(name), F.lit("&#")), _numeric(F.col(name))).otherwise(F.col(name)))
    named = F.col(name)
    for entity, char in ENTITIES.items():
        named = F.replace(named, F.lit(f"&{entity};"), F.lit(char))
    df = df.withColumn(name, F.when(F.contains(F.col(name), F.lit("&")), named).otherwise(F.col(name)))
    text = F.col(name)
    for pattern, by in SPACE_RULES:
        text = F.regexp_replace(text, pattern, by)
    return df.withColumn(name, text)


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, at, n)]], F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of raw pages (page_id, url, html, and http and date where they have them): id, uri, date, HTTP head, payload and their digests."""
    payload, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))
    if "http" in pages.columns:
        http = F.coalesce("http", http)
    when = F.coalesce("date", F.lit(date)) if "date" in pages.columns else F.lit(date)
    base = pages.select("page_id", uri.alias("uri"), when.alias("date"), http.alias("http"), payload.alias("payload"))
    digest = lambda c: F.concat(F.lit("sha1:"), F.sha1(c))
    base = base.select("*", digest("payload").alias("payload_digest"), digest(F.concat("http", "payload")).alias("block_digest"))
    return base.withColumn("record_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("uri"), F.col("block_digest")))


def derive(source: DataFrame) -> DataFrame:
    """Two rows for each response: record_type, record_id, refers_to, uri, content_type, block, block_digest, record (the serialized bytes)."""
    title = F.trim(F.regexp_extract("payload", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    head_lines = F.transform(F.split(F.rtrim(F.col("http"), F.lit(CRLF)), CRLF, -1), lambda line: F.concat(F.lit("source-http: "), line))
    fields = F.concat(
        F.lit("source-block-digest: "), F.col("block_digest"), F.lit(f"{CRLF}source-payload-digest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}source-content-length: "), F.octet_length(F.concat("http", "payload")).cast("string"), F.lit(CRLF), F.array_join(head_lines, CRLF),
        F.lit(f"{CRLF}title: "), F.regexp_replace(title, r"[\r\n]+", " "), F.lit(CRLF),
    )
    part = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    both = with_text(source, "payload", "__text").select("page_id", "uri", "date", F.col("record_id").alias("refers_to"), F.explode(F.array(part("metadata", "application/warc-fields", fields), part("conversion", "text/plain", F.col("__text")))).alias("d"))
    flat = both.select("page_id", "uri", "date", "refers_to", "d.*").withColumn("record_id", record_id(F.col("record_type"), F.col("refers_to"))).withColumn("block_digest", F.concat(F.lit("sha1:"), F.sha1("block")))
    head = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")]
    lines = [x for name, col in head for x in (F.lit(f"{name}: "), F.col(col), F.lit(CRLF))]
    record = F.concat(F.lit(f"WARC/1.0{CRLF}"), *lines, F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF))
    return flat.withColumn("record", record)


def write_records(made: DataFrame, path: str) -> None:
    """The records as files, one after another."""
    made.select(F.expr("left(record, length(record) - 2)").alias("record")).write.option("lineSep", CRLF).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """headers (a map), block and whole (whether the length stated is the block's) of records in files; a block that holds the mark
    of a record's begin is split there, and its parts are not whole."""
    got = spark.read.option("lineSep", f"WARC/1.0{CRLF}").text(path).where("value <> ''")
    head = F.substring_index("value", CRLF + CRLF, 1)
    entries = F.transform(F.split(head, CRLF, -1), lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.substring(x, F.instr(x, ": ") + 2, F.length(x)).alias("v")))
    block = F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)")
    out = got.withColumn("head", head).select(F.map_from_entries(entries).alias("headers"), block.alias("block"))
    return out.withColumn("whole", F.coalesce(F.try_element_at("headers", F.lit("Content-Length")).cast("int") == F.octet_length("block"), F.lit(False)))


def op7_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Per page and derivative: its linkage, its digest and the digest of the whole serialized record."""
    made = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return made.select("page_id", "record_type", "record_id", "refers_to", "uri", "block_digest", F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"))
