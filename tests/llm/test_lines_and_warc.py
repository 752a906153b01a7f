import hashlib

from pyspark.sql import functions as F

from fieldtopo.llm import line_dedup, warc

from .helpers import AWKWARD, empty, frame

NOTE = "Copyright 2021 by the authors of this page"


def lines_of(spark, rows):
    return {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}


def test_recurring_templates_go_but_in_the_first_document(spark):
    rows = [(i, f"{'abcdefgh'[i]} {'bcdefghi'[i]}{i} own\nCopyright 20{10 + i} by the authors of this page") for i in range(1, 6)]
    got = lines_of(spark, rows)
    assert got[1] == (rows[0][1], 0)
    assert all(got[i] == (rows[i - 1][1].split("\n")[0], 1) for i in range(2, 6))


def test_varying_words_are_fields_too(spark):
    names = ["alice", "bob", "carol", "dave", "erin"]
    rows = [(i, f"{'pqrst'[i]} stays\nThis article was written by {n} for the daily news of today") for i, n in enumerate(names)]
    got = lines_of(spark, rows)
    assert got[0][1] == 0 and [got[i][1] for i in range(1, 5)] == [1] * 4


def test_rare_short_and_repeated_lines_stay(spark):
    rows = [(1, f"{NOTE}\n{NOTE}"), (2, NOTE), (3, "a b c"), (4, "a b c"), (5, "a b c"), (6, "The first of three lines that begin alike but go on freely"), (7, "The first of many roads was never taken by me at all")]
    assert all(n == 0 for _, n in lines_of(spark, rows).values())


def test_long_passage_in_two_documents(spark):
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = lines_of(spark, [(1, f"x\n{passage}"), (2, f"{passage}\ny"), (3, "z")])
    assert got[1][1] == 0 and got[2] == ("y", 1)


def test_a_leaf_holds_several_templates(spark):
    """Two templates and single lines share the token count and the leading tokens; the most common tokens mix them."""
    names = [f"n{c}" for c in "abcdefghij"]
    first = [f"This page was made by {n} with tools from the old shop" for n in names]
    second = [f"This page was seen near {n} while birds flew over every roof" for n in names[:4]]
    alone = ["This page was lost since yesterday evening though nobody asked why it went"]
    rows = [(i, f"{'abcdefghijklmnopq'[i]} own\n{t}") for i, t in enumerate([*first, *second, *alone])]
    got = lines_of(spark, rows)
    assert [got[i][1] for i in range(15)] == [0] + [1] * 9 + [0] + [1] * 3 + [0]


def test_fields_in_lines_of_few_tokens(spark):
    names = [f"n{c}" for c in "abcdefgh"]
    six = lines_of(spark, [(i, f"{n} own\nposted on Monday by {n} again") for i, n in enumerate(names)])
    assert [six[i][1] for i in range(8)] == [0] + [1] * 7
    four = lines_of(spark, [(i, f"{n} own\nwritten down by {n}") for i, n in enumerate(names)])
    assert [four[i][1] for i in range(8)] == [0] + [1] * 7
    few = lines_of(spark, [(i, f"{n} own\nwritten down by {n}") for i, n in enumerate(names[:5])])
    assert all(n == 0 for _, n in few.values())


def test_short_lines_recur_from_more_documents_on(spark):
    rows = [(i, f"{chr(97 + i)}{chr(98 + i)} own words of this text\nAll rights reserved.\n\n12") for i in range(25)]
    got = lines_of(spark, rows)
    assert got[0] == (rows[0][1], 0) and all(got[i] == (rows[i][1].replace("All rights reserved.\n", ""), 1) for i in range(1, 25))
    assert all(n == 0 for _, n in lines_of(spark, rows[:5]).values())


def test_passages_of_several_lines_in_two_documents(spark):
    lines = [" ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(n)) for i, n in enumerate([9, 3, 12, 1, 8, 14, 5])]
    passage = "\n".join(lines)
    few = "\n".join(" ".join(f"z{chr(97 + i)}{chr(97 + k)}" for k in range(13)) for i in range(3))  # 39 tokens
    got = lines_of(spark, [(1, f"first\n{passage}\nmore"), (2, f"head\n{passage}\ntail"), (2, f"head\n{passage}\ntail"), (3, f"{few}\nother"), (6, f"{few}\nanother"), (4, None), (5, "")])
    assert got[1][1] == 0 and got[2] == ("head\ntail", len(lines)) and got[3][1] == got[6][1] == 0
    assert line_dedup.dedup_lines(frame(spark)).count() == len(AWKWARD) and line_dedup.dedup_lines(empty(spark)).count() == 0


def test_awkward_lines(spark):
    got = line_dedup.dedup_lines(frame(spark))
    assert got.count() == len(AWKWARD) and "extra" in got.columns
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(str(t) for _, t in AWKWARD)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_clashing_columns_are_replaced_or_kept(spark):
    df = spark.createDataFrame([(1, "a line of the text\nits second line", "n", 5), (2, "a line of the text", "m", 6)], "doc_id long, text string, n_lines string, n_dropped long")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].n_lines == 2 and got[1].n_dropped == 0
    own = {r.doc_id: r for r in line_dedup.dedup_lines(df, names=("__a", "__b")).collect()}
    assert own[1].n_lines == "n" and own[2].n_dropped == 6 and own[1]["__a"] == 2


PAGES = [(1, "http://a/", "<html><title>T &amp; U</title><script>x<y</script><p>Hello&nbsp;<b>world</b></p>é</html>"), (1, "http://a/", "<p>again</p>"), (2, None, "<p>x"), (3, "http://b/", None), (None, "u", "")]


def test_derivatives_refer_to_their_response(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS record_id", "1 AS block")
    source, made = warc.responses(pages), warc.derive(warc.responses(pages)).collect()
    ids = {r.record_id: r for r in source.collect()}
    assert len(made) == 2 * len(PAGES) == len({r.record_id for r in made}) and len(ids) == len(PAGES)
    for r in made:
        assert r.refers_to in ids and f"WARC-Refers-To: {r.refers_to}\r\n" in r.record
        head, _, body = r.record.partition("\r\n\r\n")
        assert f"Content-Length: {len(r.block.encode())}" in head and body == r.block + "\r\n\r\n"
        assert r.block_digest == "sha1:" + hashlib.sha1(r.block.encode()).hexdigest()
    text = next(r.block for r in made if r.record_type == "conversion" and "Hello" in r.block)
    assert text == "T & U\nHello world\né"
    assert warc.derive(warc.responses(pages.where("page_id = 99"))).count() == 0


def text_of(spark, html):
    df = spark.createDataFrame([(html,)], "h string")
    return warc.with_text(df, "h", "t").first().t


def test_text_of_awkward_html(spark):
    assert text_of(spark, "<script>var x = '</style>'; leak()</script>a <b title='a>b'>bold</b> 3 < 4 and 7 > 2") == "a bold 3 < 4 and 7 > 2"
    assert text_of(spark, "x &mdash; y &#8217; &#x1F642; &amp;lt; &#0; &#55296; &#9999999; &#160;z") == "x \u2014 y \u2019 \U0001f642 &lt; \ufffd \ufffd \ufffd z"
    assert text_of(spark, '<p class="a">one</p><!-- <p>no</p> --><P>two<BR/>three</P><a href="odd>four</a>') == "one\ntwo\nthree\nfour"
    assert text_of(spark, "<a " + "x='" + "y" * 200_000 + "'" + " b" * 100_000 + ">end") == "end"


def test_source_heads_are_kept_and_records_read_back(spark):
    head = "HTTP/1.1 404 Gone\r\nContent-Type: text/plain\r\nX-Own: a: b\r\n\r\n"
    pages = spark.createDataFrame([(1, "http://a/", "<p>x\n\ny</p>", head, "2020-02-02T02:02:02Z"), (2, None, None, None, None)], "page_id long, url string, html string, http string, date string")
    made = warc.derive(warc.responses(pages))
    block = made.where("page_id = 1 and record_type = 'metadata'").first().block
    assert "source-http: HTTP/1.1 404 Gone\r\nsource-http: Content-Type: text/plain\r\nsource-http: X-Own: a: b\r\n" in block
    from fieldtopo.llm.common import shared_path

    path = shared_path(spark, "warc")
    warc.write_records(made, path)
    got = {r.headers["WARC-Record-ID"]: r for r in warc.read_records(spark, path).collect()}
    assert len(got) == 4 and all(r.whole for r in got.values())
    for r in made.collect():
        back = got[r.record_id]
        assert back.block == r.block and back.headers["WARC-Refers-To"] == r.refers_to and back.headers["WARC-Date"] == r.date


def test_blanks_are_looked_for_without_a_choice(spark, capsys):
    texts = [" a\tb ", "a\rb", "a\fb", "a\x0bb", "a  b", "a b", " a \n b", "x1\t 2y\n\n z", "", None, "é ü  ß"]
    made = frame(spark, list(enumerate(texts))).select("doc_id", line_dedup._masked(F.col("text")).alias("m"))
    got = {r.doc_id: r.m for r in made.collect()}
    assert [got[i] for i in range(len(texts))] == ["a b"] * 6 + ["a\nb", "<*> <*>\n\nz", "", None, "é ü ß"]
    made.explain()
    assert "\\x0B]|" not in capsys.readouterr().out  # tried at every place of every text before


def test_lines_of_one_signature_make_their_templates_once(spark):
    """Before, every fixed token of a signature made a template of its own, though it held the same lines."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(44)]
    rows = [(i, f"{'abc'[i]} own\n" + " ".join([*words[:-1], f"end{'xyz'[i]}"])) for i in range(3)]
    lines, _ = line_dedup.written(line_dedup._lines(frame(spark, rows)), "lines")
    counts, held_by, _ = line_dedup._counts(lines)
    judged, _ = line_dedup._judged(lines, counts)
    found, used = line_dedup._signatures(judged, held_by)
    assert sorted(r.first for r in found.collect()) == [0, 0, 0]
    assert spark.read.parquet(next(p for p in used if "lines-kinds" in p)).count() == 1
    assert [n for _, (_, n) in sorted(lines_of(spark, rows).items())] == [0, 1, 1]


def test_mixed_leaves_equal_their_sql(spark):
    """Few words at each place, so that signatures meet in templates that leave one more token open."""
    import random

    import duckdb
    import pandas as pd

    from fieldtopo.llm.oracles import OP10

    r = random.Random(5)
    rows = []
    for i in range(150):
        lines = []
        for n in r.choices([4, 5, 6, 7, 8, 9, 12, 41], k=4):
            w = ["the", r.choice(["page", "7"]), "of"] + [f"{'abcdefghijkl'[k % 12]}{r.choice('aaaaaabc' if n < 20 else 'aaaaaaaaaaaaaaab')}" if r.random() > 0.1 else r.choice(["12", f"u{chr(97 + i % 26)}{chr(97 + i // 26)}"]) for k in range(n - 3)]
            lines.append("  ".join(w) if r.random() < 0.1 else " ".join(w))
        rows.append((None if i % 50 == 49 else i // 2 * 2, "\n".join(lines)))
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(map(str, con.execute(OP10).fetchall()))
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(str(tuple(x)) for x in got.collect()) == want
    assert sum(x.n_dropped for x in got.collect()) > 100
