"""Line dedup by a log-template tree: token count, then leading tokens, then a leaf that holds the templates of its lines.

A line's tokens are what ASCII blanks separate; a token with a digit is a variable field `<*>`. The tree has a fixed depth: the
token count, then DEPTH leading tokens lead to a leaf. Lines that are equal once masked share a template. A leaf also holds
templates with word fields, as many as its lines show:
* its modal template (GENERAL tokens or more): the most common token of every place; lines that agree with it in SIMILAR of the
  tokens behind the leading ones belong to it;
* signatures: tokens that few documents have at their place in the leaf are fields, and each other token in turn; what is left
  fixed names the template. With fewer than GENERAL tokens, the fewer fixed words the more documents are asked for.
A template recurs if MIN_DOCS documents hold it (two, for lines of LONG tokens or more); lines of fewer than MIN_TOKENS tokens recur
from SHORT_DOCS documents on, unless they are numbers only. Consecutive lines that have LONG tokens together and stand in two
documents are one passage, and go with the blank lines between them. What recurs is dropped everywhere but in the document with
the smallest doc_id, so that no text vanishes from the corpus.

DataFrame functions only. Texts are masked whole, before they are cut into lines; every count is pre-aggregated before its shuffle, and
a leaf's own figures (one row a leaf) are written or broadcast before lines are joined to them, so a hot leaf can be split.

Edge cases: null text stays null and empty text empty (n_lines 0 and 1). Repeated rows of one doc_id are one document: they keep
or lose the same lines. Rows without doc_id count as one document, after all others. A template within one document only never
recurs. Extra columns are kept; columns with the names of the added ones (`names`) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, forget, written

DEPTH, MIN_TOKENS, MIN_DOCS, LONG, GENERAL, SIMILAR = 3, 4, 3, 40, 8, 0.6
SHORT_DOCS = {1: 20, 2: 12, 3: 6}  # documents that make a line of fewer than MIN_TOKENS tokens recur
FEW_WORDS = 6  # with fewer than GENERAL tokens, a template needs MIN_DOCS + FEW_WORDS documents, less one for each fixed word
BROADCAST_ROWS = 200_000
NO_ID = 2**63 - 1
_NUMBERED = r"(\s|^)[^\s0-9]*+[0-9]\S*+"
_OTHER = r"(?<!\S)(?!<\*>(?!\S))\S"  # a token that is not the field mark


def _masked(text: Column) -> Column:
    """The text with masked tokens, one space between the tokens of a line and none at its ends."""
    # Each search reads every text: digits and odd blanks are one class (of single characters, which is one table), fixed strings go without
    # patterns. Only what has one is masked. Masking leaves blanks as they are.
    two = F.contains(text, F.lit("  "))
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, _NUMBERED, "$1<*>")).otherwise(text)
    single = F.when(text.rlike(r"[\t\r\f\x0B]") | two, F.regexp_replace(masked, r"[ \t\r\f\x0B]+", " ")).otherwise(masked)
    single = F.when(text.rlike(r"[0123456789\t\r\f\x0B]") | two, single).otherwise(text)
    inner = F.replace(F.replace(single, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.trim(inner)  # of spaces only; a given set of characters would be looked up for each character of the text


def _lines(docs: DataFrame) -> DataFrame:
    """did, text_key, k (place among the text's lines with a token), line_no, bare (the masked line), n_tokens, leaf, line of each of these."""
    each = F.transform(F.split(_masked(F.col("text")), "\n", -1), lambda x, i: F.struct(i.alias("line_no"), x.alias("bare")))
    # Outer, as Spark would else add a filter on the array's size and push it down, which makes the array twice.
    filled = F.posexplode_outer(F.filter(each, lambda x: x["bare"] != "")).alias("k", "at")
    cut = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("did"), F.xxhash64("text").alias("text_key"), filled).select("did", "text_key", "k", "at.line_no", "at.bare")
    cut = cut.where("bare is not null").withColumn("n_tokens", F.octet_length("bare") - F.octet_length(F.replace("bare", F.lit(" "), F.lit(""))) + 1)
    leaf = F.xxhash64("n_tokens", F.substring_index("bare", " ", DEPTH))
    return cut.withColumn("leaf", leaf).withColumn("line", F.xxhash64("bare", F.lit("line")))


def _rare() -> Column:
    return F.when(F.col("n_tokens") >= LONG, 2).otherwise(MIN_DOCS)


def _cell() -> Column:
    """A token at its place in a leaf, as a hash whose last bit tells a word from the field mark."""
    return F.xxhash64("leaf", "pos", "token").bitwiseAND(-2).bitwiseOR((F.col("token") != "<*>").cast("long")).alias("h")


def _judged(lines: DataFrame, counts: DataFrame) -> tuple[DataFrame, list[str]]:
    """The lines that share a leaf with others, with what the leaf's votes say of them; and the written tables.

    leaf, line, n_tokens, n_docs, first; lead: leading tokens that are no fields; sig, same, words, parts: the signature, its fixed
    tokens, how many of these are no field marks, and their cells; agree: places where the line has the leaf's most common token."""
    leaves = counts.where(F.col("n_tokens") >= MIN_TOKENS).groupBy("leaf", "n_tokens").agg(F.count("*").alias("k"), F.sum("n_docs").alias("w")).where((F.col("k") > 1) & (F.col("w") >= _rare())).select("leaf")
    leaves, leaves_at = written(leaves, "lines-leaves")
    bare = lines.select("leaf", "line", "bare").join(broadcast_if(leaves, leaves.count(), BROADCAST_ROWS), "leaf", "left_semi").groupBy("line", "leaf").agg(F.min("bare").alias("bare"))
    some = bare.join(counts.select("leaf", "line", "n_tokens", "n_docs", "first"), ["line", "leaf"]).withColumn("tokens", F.split("bare", " ", -1))
    lead = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda t: t != "<*>"))
    some, some_at = written(some.select("leaf", "line", lead.alias("lead"), "n_tokens", "n_docs", "first", "tokens"), "lines-several")
    cells = some.select("leaf", "line", "n_tokens", "n_docs", F.posexplode_outer("tokens").alias("pos", "token")).where(F.col("pos") >= DEPTH)
    votes, votes_at = written(cells.groupBy("leaf", "n_tokens", "pos", "token").agg(F.sum("n_docs").alias("w")), "lines-votes")
    # Keys that differ from row to row come first: sorting compares the others only where these are equal.
    place = votes.where(F.col("n_tokens") >= GENERAL).groupBy(F.xxhash64("leaf", "pos").alias("at"), "leaf", "pos")
    top = place.agg(F.max(F.struct("w", "token")).alias("m")).select("leaf", "pos", "m.token")
    fixed = votes.where(F.col("w") >= _rare()).select(_cell(), "leaf", F.lit(1).alias("fixed"), F.lit(0).alias("modal"))
    marks = fixed.unionByName(top.select(_cell(), "leaf", F.lit(0).alias("fixed"), F.lit(1).alias("modal"))).groupBy("h", "leaf").agg(F.max("fixed").alias("fixed"), F.max("modal").alias("modal"))
    # A line's tokens come from all over, so adding them up before the shuffle would save nothing.
    met = cells.select(_cell(), "leaf", "line").join(marks.hint("shuffle_hash"), ["h", "leaf"]).repartition("line", "leaf")
    told = met.groupBy("line", "leaf").agg(
        F.expr("bit_xor(if(fixed = 1, h, null))").alias("sig"), F.sum("fixed").alias("same"), F.sum(F.col("fixed") * F.col("h").bitwiseAND(1)).alias("words"),
        F.collect_list(F.when(F.col("fixed") == 1, F.col("h"))).alias("parts"), F.sum("modal").alias("agree"),
    )
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sig", "same", "words", "agree")]
    kept = some.drop("tokens").join(told, ["line", "leaf"], "left").select("leaf", "line", "lead", "n_tokens", "n_docs", "first", *zero, "parts")
    out, out_at = written(kept, "lines-judged")
    forget(lines.sparkSession, leaves_at, some_at, votes_at)
    return out, [out_at]


def _documents(members: DataFrame, held_by: DataFrame, of: list[str]) -> DataFrame:
    """(of, did) of the documents that hold any of the lines (leaf, line, n_docs, first, and the columns of)."""
    one = members.where("n_docs = 1").select(*of, F.col("first").alias("did"))
    more = members.where("n_docs > 1").select("leaf", "line", *[c for c in of if c != "leaf"]).join(held_by, ["leaf", "line"]).select(*of, "did")
    return one.unionByName(more).distinct()


def _modal(judged: DataFrame, held_by: DataFrame) -> tuple[DataFrame, list[str]]:
    """(leaf, line, first) of the lines that belong to their leaf's modal template, where it recurs; and the written tables."""
    members = judged.where((F.col("n_tokens") >= GENERAL) & (F.col("agree") >= SIMILAR * (F.col("n_tokens") - DEPTH))).select("leaf", "line", "n_tokens", "n_docs", "first")
    held, held_at = written(_documents(members, held_by, ["leaf"]).groupBy("leaf").agg(F.count("*").alias("n_in"), F.min("did").alias("least")).where(F.col("n_in") > 1), "lines-held")
    found = members.join(broadcast_if(held, held.count(), BROADCAST_ROWS), "leaf").where(F.col("n_in") >= _rare())
    return found.select("leaf", "line", F.col("least").alias("first")), [held_at]


def _signatures(judged: DataFrame, held_by: DataFrame) -> tuple[DataFrame, list[str]]:
    """(leaf, line, first) of the lines that belong to a recurring template with word fields; and the written tables.

    Lines of one signature have the same templates, so these are made once for all of them. A template that leaves one more token open
    is looked at only where several signatures meet in it: with one alone it holds the lines that the signature holds, and needs no
    fewer documents."""
    held = F.col("words") + F.col("lead")
    alike = F.when(F.col("n_tokens") >= GENERAL, F.col("same") >= SIMILAR * (F.col("n_tokens") - DEPTH)).otherwise(held >= SIMILAR * F.col("n_tokens"))
    need = F.when(F.col("n_tokens") >= GENERAL, _rare()).otherwise(F.greatest(F.lit(MIN_DOCS), MIN_DOCS + FEW_WORDS - held.cast("int"))).cast("int").alias("need")
    # Lines of few tokens may have fields only behind the leading ones: nothing fixed, and 0 for a signature.
    signed = judged.where((F.col("same") > 0) | (F.col("n_tokens") < GENERAL)).where(alike)
    size = [F.count("*").alias("k"), F.sum("n_docs").alias("w"), F.max("n_docs").alias("most"), F.min("first").alias("first")]
    own, own_at = written(signed.groupBy("sig", "leaf", "lead", "n_tokens", "same", "words").agg(*size, F.first("parts").alias("parts")), "lines-signed")
    # A field's value may be common too: the signature with each one of its fixed tokens as a field as well.
    less = own.select("*", F.explode("parts").alias("p")).withColumns({"kind": F.col("sig").bitwiseXOR(F.col("p")), "same": F.col("same") - 1, "words": F.col("words") - F.col("p").bitwiseAND(1)})
    of = ["kind", "leaf", "sig", "k", "w", "most", "first"]
    every = own.withColumn("kind", F.col("sig")).select(*of, need).unionByName(less.where(alike).select(*of, need))
    kinds = every.groupBy("kind", "leaf").agg(
        F.count("*").alias("sigs"), F.count_if(F.col("kind") == F.col("sig")).alias("own"), F.sum("k").alias("k"), F.sum("w").alias("w"),
        F.max("most").alias("most"), F.min("first").alias("first"), F.max("need").alias("need"),
    ).where("k > 1 and w >= need and (sigs > 1 or own > 0)")
    kinds, kinds_at = written(kinds.select("kind", "leaf", "most", "first", "need"), "lines-kinds")
    held_in, held_at = written(every.select("kind", "leaf", "sig").join(broadcast_if(kinds, kinds.count(), BROADCAST_ROWS), ["kind", "leaf"]), "lines-of-kinds")
    # Where no line of a template has enough documents alone, few have each of its lines, and they are counted together.
    sure, open_ = held_in.where("most >= need"), held_in.where("most < need")
    few = signed.select("leaf", "line", "n_docs", "first", "sig").join(open_.select("kind", "leaf", "sig"), ["sig", "leaf"]).drop("sig")
    counted = _documents(few, held_by, ["leaf", "kind"]).groupBy("kind", "leaf").agg(F.count("*").alias("n_in"))
    enough = open_.join(counted, ["kind", "leaf"]).where("n_in >= need")
    found = sure.select("sig", "leaf", "first").unionByName(enough.select("sig", "leaf", "first")).groupBy("sig", "leaf").agg(F.min("first").alias("first"))
    return signed.select("sig", "leaf", "line").join(found, ["sig", "leaf"]).select("leaf", "line", "first"), [own_at, kinds_at, held_at]


def _counts(lines: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """(leaf, line, n_tokens, n_docs, first) of all lines; (leaf, line, did) of those in several documents; and the written tables.

    Most lines stand in one document, which its least and largest id tell; only the others have their documents counted."""
    ends, ends_at = written(lines.groupBy("leaf", "line", "n_tokens").agg(F.min("did").alias("first"), F.max("did").alias("last")), "lines-ends")
    several = ends.where("first <> last").select("leaf", "line")
    held_by, held_at = written(lines.select("leaf", "line", "did").join(broadcast_if(several, several.count(), BROADCAST_ROWS), ["leaf", "line"], "left_semi").distinct(), "lines-held-by")
    n = held_by.groupBy("leaf", "line").agg(F.count("*").alias("n_docs"))
    one = ends.where("first = last").withColumn("n_docs", F.lit(1).cast("long"))
    counts = ends.where("first <> last").join(n, ["leaf", "line"]).select(*one.columns).unionByName(one).select("leaf", "line", "n_tokens", "n_docs", "first")
    counts, counts_at = written(counts, "lines-counts")
    forget(lines.sparkSession, ends_at)
    return counts, held_by, [counts_at, held_at]


def recurring(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(leaf, line, first) of the lines to drop elsewhere than in `first`; the table of all lines; (leaf, line) of those in several documents;
    and where these tables are written."""
    lines, lines_at = written(_lines(docs), "lines")
    counts, held_by, counts_at = _counts(lines)
    enough = F.when(F.col("n_tokens") >= MIN_TOKENS, _rare())
    for n, most in SHORT_DOCS.items():
        enough = enough.when(F.col("n_tokens") == n, most)
    exact = counts.where(F.col("n_docs") >= enough)
    short = lines.where(F.col("n_tokens") < MIN_TOKENS).where(~F.col("bare").rlike(_OTHER)).select("leaf", "line").distinct()
    exact = exact.join(short, ["leaf", "line"], "left_anti").select("leaf", "line", "first")
    judged, judged_at = _judged(lines, counts)
    modal, used = _modal(judged, held_by)
    fields, more = _signatures(judged, held_by)
    table, table_at = written(exact.unionByName(modal).unionByName(fields).groupBy("leaf", "line").agg(F.min("first").alias("first")), "lines-recurring")
    shared, shared_at = written(counts.where("n_docs > 1").select("leaf", "line"), "lines-shared")
    forget(docs.sparkSession, *counts_at, *judged_at, *used, *more)
    return table, lines, shared, [lines_at, table_at, shared_at]


def _passages(lines: DataFrame, shared: DataFrame) -> tuple[DataFrame, str]:
    """(did, text_key, line_no) of the lines in passages that an earlier document has too; and the written table.

    A shared passage holds no line that stands in one document only, so runs of shared lines are all that is looked at. From each line
    on, and up to each line, a passage is the fewest consecutive lines that have LONG tokens together. Both kinds within a run
    cover it, so no pair of documents has to be joined."""
    at = Window.partitionBy("did", "text_key").orderBy("k")
    each = lines.select("did", "text_key", "k", "line_no", "n_tokens", "leaf", "line").join(broadcast_if(shared, shared.count(), BROADCAST_ROWS), ["leaf", "line"], "left_semi")
    each = each.select("did", "text_key", "k", "line_no", "n_tokens", F.xxhash64("leaf", "line").alias("h"))
    each = each.withColumn("last", F.lag("k").over(at)).where("last is null or last <> k")  # repeated rows
    each = each.withColumn("stop", F.sum("n_tokens").over(at.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).withColumn("start", F.col("stop") - F.col("n_tokens"))
    text = Window.partitionBy("did", "text_key", "run")
    each = each.withColumn("run", F.col("k") - F.row_number().over(at))
    after, before = text.orderBy("start").rangeBetween(0, LONG - 1), text.orderBy("stop").rangeBetween(1 - LONG, 0)
    part = lambda w: F.struct(F.xxhash64(F.collect_list("h").over(w)).alias("passage"), F.sum("n_tokens").over(w).alias("n"), F.min("line_no").over(w).alias("low"), F.max("line_no").over(w).alias("high"))
    both = each.select("did", "text_key", part(after).alias("a"), part(before).alias("b")).select("did", "text_key", F.explode(F.array("a", "b")).alias("p")).select("did", "text_key", "p.*")
    both, both_at = written(both.where(F.col("n") >= LONG).drop("n"), "lines-passages")
    twice = both.groupBy("passage").agg(F.min("did").alias("first"), F.max("did").alias("other")).where("first <> other").drop("other")
    return both.join(twice, "passage").where(F.col("did") > F.col("first")).select("did", "text_key", F.explode(F.sequence("low", "high")).alias("line_no")), both_at


def dedup_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with `text` without its dropped lines, and the numbers (long) of its lines and of the dropped ones in columns of these names."""
    table, lines, shared, used = recurring(docs)
    passages, passages_at = _passages(lines, shared)
    table = broadcast_if(table, table.count(), BROADCAST_ROWS)
    gone = lines.join(table, ["leaf", "line"]).where(F.col("did") > F.col("first")).select("did", "text_key", "line_no").unionByName(passages)
    dropped = gone.groupBy("did", "text_key").agg(F.collect_set("line_no").alias("__drop"))
    dropped, _ = written(dropped.withColumnsRenamed({"did": "__did", "text_key": "__key"}), "lines-dropped")
    forget(docs.sparkSession, passages_at, *used)  # what is left to do reads the texts and the dropped lines only
    docs = docs.drop(*names)
    # The dropped lines are few beside the texts: these are not sorted for the join.
    own = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == dropped["__did"]) & (F.xxhash64(docs["text"]) == dropped["__key"])
    joined = docs.join(dropped.hint("shuffle_hash"), own, "left").withColumn("__parts", F.when(F.col("__drop").isNotNull(), F.split(docs["text"], "\n", -1)))
    # A mask of all lines first, so that each line is looked up in it and not in the dropped ones' list.
    mask = F.when(F.col("__drop").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__drop"))
    kept = F.transform(F.col("__kept"), lambda i: F.get(F.col("__parts"), i))
    text = F.when(F.col("__drop").isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.octet_length(docs["text"]) - F.octet_length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_dropped = F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    out = joined.withColumn("__kept", mask)
    return out.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], n_lines.alias(names[0]), F.greatest(n_dropped, F.lit(0)).cast("long").alias(names[1]))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
