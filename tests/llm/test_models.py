import numpy as np

from fieldtopo.llm import language, toxicity
from fieldtopo.llm.registry import QUERIES

from .helpers import empty, frame


def test_language_on_held_out_rows(spark, sf_dir):
    got = QUERIES["op9_language_id"](spark, sf_dir).toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(truth, on="doc_id")
    m = m[m.held_out]
    assert len(m) > 10 and (m.lang == m.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_awkward_rows(spark):
    profiles = {"en": language.ranking("the quick brown fox and the dog"), "de": language.ranking("der schnelle braune fuchs und der hund")}
    got = language.identify(frame(spark), profiles)
    rows = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got.collect()}
    assert rows[(1, None)] == rows[(2, "")] == rows[(4, "!!! ??? 123")] == ("und", 0.0)
    assert rows[(9, "the quick brown fox jumps over the lazy dog " * 3000)][0] == "en"
    assert got.count() == frame(spark).count() and "extra" in got.columns
    assert language.identify(frame(spark), {}).where("lang_pred <> 'und'").count() == 0
    assert language.learn_profiles(empty(spark).selectExpr("*", "'en' AS lang")) == {}


def test_rare_languages_keep_their_profiles(spark):
    """One language has all but a few rows of many; each of the others is still learnt from all its rows."""
    rows = [(i, "the quick brown fox and the lazy dog", "en") for i in range(3000)]
    rows += [(5000 + i, "der schnelle braune fuchs und der faule hund", "de") for i in range(3)] + [(6000, "le renard brun et le chien", "fr")]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(labelled, 60)
    assert sorted(profiles) == ["de", "en", "fr"]
    assert np.array_equal(profiles["fr"], language.ranking(rows[-1][1]))
    got = language.identify(spark.createDataFrame([(1, "le chien et le renard")], "doc_id long, text string"), profiles)
    assert got.first().lang_pred == "fr"
    share = language.shares({"en": 3000, "de": 3, "fr": 1}, 60)
    assert share["de"] == share["fr"] == 1.0 and abs(share["en"] * 3000 - 56) < 1e-6
    assert set(language.shares({"en": 30, "de": 3}, 60).values()) == {1.0}


def test_rankings_follow_counts_then_codes():
    grams, counts = language.ngrams("Aa b")
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True))[ord("a")] == 2
    head = language.ranking("aab")
    assert head[0] == ord("a")


def test_toxicity_on_held_out_rows(spark):
    got = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    pos, neg = m[m.toxic == 1].score.to_numpy(), m[m.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
    assert auc > 0.75 and got.score.between(0, 1).all()


def test_toxicity_tolerates_gaps(spark):
    f = toxicity.Featuriser(["idiot", "worthless"])
    x = f.features(["you idiot", "you i.d.i.o.t", "you id-iot!", "you i d i o t", "you idi0ot", "WORTHLESS", "a clean text", None, ""])
    assert (x[:5, 0] >= toxicity.FLOOR).all() and x[0, 0] > 0.99 and x[3, 0] > 0.99 and x[5, 1] > 0.99
    assert not x[6:].any()


def test_toxicity_reads_long_tokens_to_their_end(spark):
    f = toxicity.Featuriser(["idiot", "worthless", "scum"])
    rng = np.random.default_rng(3)
    glue = "".join(rng.choice(list("abefghjklmnpqvxyz"), 3000))
    letters = "thankyouforthelonglistofnoteswhichwehavereadthismorningyouareanidiot"
    for i, word in enumerate(["idiot", "worthless", "scum"]):
        for n in (0, 40, 61, 64, 65, 1000, 1007, 2999):
            x = f.features([glue[:n] + word, glue[:n] + word + glue[: 3000 - n], ".".join([*glue[:n], *word])])
            assert (x[:, i] >= toxicity.FLOOR).all(), (word, n)
    x = f.features([" ".join(letters), " ".join(letters[:-5]), glue])
    assert x[0, 0] >= toxicity.FLOOR and not x[1:, 0].any()


def test_words_at_once_equal_word_by_word():
    rng = np.random.default_rng(0)
    f = toxicity.Featuriser(["idiot", "loweischaft", "pathetic"])
    words = ["".join(rng.choice(list("abdeiothwclps"), rng.integers(3, 12))) for _ in range(2000)] + ["idiots", "pathetically", "loweient"]
    words = list(dict.fromkeys(words))
    near = {w: (at, k) for w, at, k in f._near(words)}
    assert set(near) == {w for w in words if f.kernel(w).max() >= toxicity.FLOOR}
    for w, (at, k) in near.items():
        whole = f.kernel(w)
        assert at.tolist() == np.flatnonzero(whole >= toxicity.FLOOR).tolist() and np.allclose(k, whole[at], atol=1e-12)


def test_toxicity_awkward_rows(spark):
    rows = [(i, f"word{i} " + ("idiot " if i % 2 else "friend ") * 2 + "text body") for i in range(40)]
    train = spark.createDataFrame([(i, t, i % 2) for i, t in rows], "doc_id long, text string, toxic int")
    model = toxicity.train(train)
    got = toxicity.score_toxicity(frame(spark, [*rows, (90, None), (91, ""), (92, "what an i.d.i.o.t")]), model)
    s = {r.doc_id: r.score for r in got.collect()}
    assert s[1] > 0.5 > s[2] and s[92] > s[2] and 0 <= s[90] == s[91] < 0.5
    assert toxicity.train(train.where("toxic = 1")) is None
    assert toxicity.score_toxicity(empty(spark), None).count() == 0


def test_kernel_equals_a_plain_sum_over_subsequences():
    """The gap-weighted kernel by its definition: all index triples of a small span."""

    def plain(word):
        out = {}
        for i in range(len(word)):
            for k in range(i + 1, len(word)):
                for m in range(k + 1, min(len(word), i + 5)):
                    key = word[i] + word[k] + word[m]
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (m - i - 2)
        return out

    def cosine(a, b):
        x, y = plain(a), plain(b)
        size = lambda p: sum(v * v for v in p.values()) ** 0.5
        return sum(v * y.get(k, 0.0) for k, v in x.items()) / ((size(x) * size(y)) or 1.0)

    rng, marks = np.random.default_rng(4), ["idiot", "worthless", "aaaa"]
    f = toxicity.Featuriser(marks)
    for word in ["".join(rng.choice(list("aidotwrhles"), n)) for n in rng.integers(1, 14, 300)] + ["idiot", "i-d-i-o-t", "aaa"]:
        assert np.allclose(f.kernel(word), [cosine(word, m) for m in marks])


def test_toxicity_scores_equal_the_model_row_by_row(spark):
    """Clashing columns, repeated rows and a very long text: each row's score is that of its text alone."""
    rows = [(i, ("you idiot " if i % 2 else "dear friend ") + f"number{i}") for i in range(60)]
    model = toxicity.train(spark.createDataFrame([(i, t, i % 2) for i, t in rows], "doc_id long, text string, toxic int"))
    texts = [(1, "plain words " * 40_000 + "idiot"), (2, "you idiot"), (2, "you idiot"), (3, None), (4, "")]
    got = toxicity.score_toxicity(frame(spark, texts), model).collect()
    f = toxicity.Featuriser(model.landmarks)
    assert len(got) == len(texts) and all(abs(r.score - model.score(f.features([r.text]))[0]) < 1e-12 for r in got)
    assert got[0].score > 0.5 and got[1].score == got[2].score and got[3].score == got[4].score < 0.5


def test_labels_are_drawn_before_texts_are_read(spark):
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 10 = 0 AS INT) AS toxic")
    n = {r["toxic"]: r["count"] for r in toxicity.draw(labels, 200).groupBy("toxic").count().collect()}
    assert 140 < n[0] < 270 and 140 < n[1] < 270
    assert toxicity.draw(labels, 10_000).count() == 4000 and toxicity.draw(labels.where("toxic = 0"), 10_000).count() == 3600


def test_counting_holds_few_ngrams_at_once(monkeypatch):
    """A batch's n-grams are added up as they come: the same counts, and arrays no longer than what may be held and one text's n-grams."""
    rng, longest, plain = np.random.default_rng(8), [], np.concatenate
    texts = ["".join(rng.choice(list("abcde "), 200)) for _ in range(400)] + [None, "", "123"]
    batch = language.pa.RecordBatch.from_pydict({"text": texts, "lang": ["en" if i % 3 else "de" for i in range(len(texts))]})
    want: dict = {}
    for text, lang in zip(texts, batch.column(1).to_pylist(), strict=True):
        for g, n in zip(*language.ngrams(text), strict=True):
            want[lang, int(g)] = want.get((lang, int(g)), 0) + int(n)
    monkeypatch.setattr(language, "HELD", 2_000, raising=False)
    monkeypatch.setattr(np, "concatenate", lambda x, *a, **k: longest.append(len(out := plain(x, *a, **k))) or out)
    got = [r for b in language._count(iter([batch])) for r in b.to_pylist()]
    assert len(got) == len(want) and {(r["lang"], r["gram"]): r["n"] for r in got} == want
    assert max(longest) < 3_000


def test_languages_are_returned_a_few_rows_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 7, raising=False)
    profiles = {"en": language.ranking("the quick brown fox and the dog"), "de": language.ranking("der schnelle braune fuchs und der hund")}
    rows = [(i, "the fox" if i % 2 else "der hund und") for i in range(30)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), profiles).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got)


def test_out_of_place_distance_equals_a_plain_version(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]

    def grams(text):
        clean = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        clean = " ".join(["", *clean.split(), ""])
        n = {}
        for size in (1, 2, 3):
            for i in range(len(clean) - size + 1):
                g = clean[i : i + size]
                if g != " ":
                    n[g] = n.get(g, 0) + 1
        pack = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], pack(x[0])))][: language.PROFILE]

    profiles = {"b": texts[0], "a": texts[1], "c": "der schnelle fuchs"}
    model = language._Model({k: language.ranking(t) for k, t in profiles.items()})
    for text in texts[2:]:
        mine, best = grams(text), None
        for lang in sorted(profiles):
            rank = {g: i for i, g in enumerate(grams(profiles[lang]))}
            d = sum(min(abs(rank[g] - i), language.PROFILE) if g in rank else language.PROFILE for i, g in enumerate(mine)) / max(len(mine), 1)
            if best is None or d < best[1]:
                best = lang, d
        got = model.predict(text)
        assert not mine or (got[0] == best[0] and abs(got[1] - (1 - best[1] / language.PROFILE)) < 1e-9)
    same = {"x": language.ranking("abc"), "w": language.ranking("abc")}
    assert language._Model(same).predict("abc")[0] == "w"  # ties go to the language that sorts first


def test_landmarks_of_any_script(spark):
    """Astral characters, and alphabets too large for a table of all triples, give what the kernel gives."""
    rng = np.random.default_rng(2)
    signs = [chr(c) for c in (*range(0x4E00, 0x4E00 + 300), *range(0x1F600, 0x1F640))]
    landmarks = ["".join(rng.choice(signs, 6)) for _ in range(60)] + ["🙂🙃🙂🙃", "oaf"]
    f = toxicity.Featuriser(landmarks)
    assert f.table is None and toxicity.Featuriser(["oaf", "idiot"]).table is not None
    words = [w[:3] + str(rng.choice(signs)) + w[3:] for w in landmarks] + landmarks + ["🙂🙃🙂", "oafs", "zzz"]
    assert {w for w, _, _ in f._near(words)} == {w for w in words if f.kernel(w).max() >= toxicity.FLOOR}
    assert not list(f._near(["zzz"]))
    for w in words:
        k = np.max([f.kernel(x) for x in toxicity.forms(w)], axis=0)  # also without what is neither letter nor digit
        assert np.allclose(f.features([f"so {w} there"])[0], np.where(k >= toxicity.FLOOR, k, 0.0))


def test_short_insults_are_learnt(spark):
    rows = [(i, f"text number word{i} " + ("you oaf" if i % 2 else "you all"), i % 2) for i in range(60)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame([(1, "what an oaf"), (2, "what a day")], "doc_id long, text string"), model).collect()}
    assert "oaf" in model.landmarks and got[1] > 0.5 > got[2]
