"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel with Nystroem landmarks.

The kernel compares words by their subsequences of three characters that span at most five, each weighing DECAY to the number
of skipped characters, so `idiot`, `id-iot`, `i.d.i.o.t` and `loweischaft` / `loweient` stay near each other. Runs of single
characters (`i d i o t`) are read as one word too. A text's feature for a landmark word is the largest normalised kernel value
that any of its words reaches (0 below FLOOR; long words and runs are read in overlapping WINDOWS, as their norm would hide what
they hold); the features are whitened by the landmarks' own kernel matrix (Nystroem), and a linear SVM with a squared hinge is fitted on them and calibrated by a logistic curve.

Learning reads a sample of labelled rows of bounded expected size (`max_train` per label); the labels are drawn first and then
broadcast, so that other texts are not read for it. Words are counted by Spark; the driver gets landmark candidates (`CANDIDATES` words) and the sample's feature rows, never its texts.

Edge cases: null and empty texts get the score of a text without any similar word. Without both labels in the sample every score is 0.
Repeated rows get the same score; whole texts are read whatever their length. `score` is replaced where the input has it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, forget, written

DECAY, FLOOR, LANDMARKS, CANDIDATES, MAX_TRAIN, CACHE = 0.5, 0.35, 96, 600, 4000, 300_000
SKIPS = [(1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2)]  # steps to the second and third character: spans 3, 4, 4, 5, 5, 5
WINDOWS, WHOLE = [(6, 2), (10, 4), (28, 14)], 64  # lengths and steps, for words longer than all of them; words up to WHOLE are read as they stand too
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S\s+){2,}\S(?=\s|$)")
TABLE = 1 << 22  # most entries of a table over all triples of the landmarks' characters
_EDGES = ".,;:!?\"'()[]{}<>*_-#$%&/\\|~`^+=@"


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words without punctuation at their ends; spaced-out single characters also count as one word."""
    if not text:
        return set()
    text = text.lower()
    tokens = text.split()
    out = set(tokens)
    if sum(map(len, tokens)) < 1.5 * len(tokens) or any(len(t) == 1 for t in out):
        out |= {re.sub(r"\s+", "", m) for m in _SPACED.findall(text)}
    return out


def profile(word: str) -> dict[str, float]:
    """The word's gapped subsequences of length three and their weights."""
    out: dict[str, float] = {}
    n = len(word)
    for a, b in SKIPS:
        weight = DECAY ** (a + b - 2)
        for i in range(n - a - b):
            key = word[i] + word[i + a] + word[i + a + b]
            out[key] = out.get(key, 0.0) + weight
    return out


def clean(word: str) -> str:
    return word.strip(_EDGES)


def pieces(word: str) -> set[str]:
    """What a word is read by: itself, or, where it is long, its windows. Those of 6 hold any word of up to five letters, those of
    10 any of up to seven or seven letters at least of a longer one, and neither has so much else that the norm hides it."""
    if len(word) <= WINDOWS[-1][0]:
        return {word}
    out = {word[max(0, min(i, len(word) - n)) :][:n] for n, step in WINDOWS for i in range(0, len(word) - n + step, step)}
    return out | {word} if len(word) <= WHOLE else out


def forms(token: str) -> set[str]:
    """How a token is read: without punctuation at its ends, and without any inside; long ones by windows."""
    word = clean(token).replace("\x00", " ")
    if word.isalnum():
        return pieces(word)
    return pieces(word) | pieces("".join(filter(str.isalnum, word)))


class Featuriser:
    """Largest kernel values of a text's words with each landmark; words seen before are looked up."""

    def __init__(self, landmarks: list[str]):
        self.m = len(landmarks)
        rows = [profile(w) for w in landmarks]
        self.index: dict[str, int] = {}
        for row in rows:
            for key in row:
                self.index.setdefault(key, len(self.index))
        self.phi = np.zeros((len(self.index), self.m))
        for j, row in enumerate(rows):
            norm = np.sqrt(sum(v * v for v in row.values())) or 1.0
            for key, v in row.items():
                self.phi[self.index[key], j] = v / norm
        chars = sorted({c for key in self.index for c in key})
        self.code = np.zeros(sys.maxunicode + 2, np.int32)  # 4 MB, whatever the alphabet
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.base = len(chars) + 1
        packed = np.array([(int(self.code[ord(x)]) * self.base + int(self.code[ord(y)])) * self.base + int(self.code[ord(z)]) for x, y, z in self.index], np.int64)
        order = np.argsort(packed)
        self.keys, self.at = packed[order], np.array(list(self.index.values()), np.int32)[order]
        # Packed subsequences that are a landmark's: a bit each where they are few, else a search; either is bounded by the landmarks.
        self.table = None
        if self.base**3 <= TABLE:
            self.table = np.full(self.base**3, -1, np.int32)
            self.table[self.keys] = self.at
        rows_at, self.columns = np.nonzero(self.phi)  # by subsequence: the landmarks that have it, and their weights
        self.values = self.phi[rows_at, self.columns]
        self.ends = np.searchsorted(rows_at, np.arange(len(self.index) + 1))
        self.near: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.far: set[str] = set()

    def kernel(self, word: str) -> np.ndarray:
        row = profile(word)
        hit = [(self.index[k], v) for k, v in row.items() if k in self.index]
        if not hit:
            return np.zeros(self.m)
        norm = np.sqrt(sum(v * v for v in row.values()))
        return np.array([v for _, v in hit]) @ self.phi[[i for i, _ in hit]] / norm

    def _lookup(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The landmarks' subsequence of three characters' codes, or -1."""
        if self.table is not None:
            return self.table[(x * self.base + y) * self.base + z]
        wanted = (x.astype(np.int64) * self.base + y) * self.base + z
        place = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        return np.where(self.keys[place] == wanted, self.at[place], -1) if len(self.keys) else np.full(len(wanted), -1)

    def _near(self, words: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Words that reach FLOOR with a landmark, these landmarks and the kernel values: all words at once, first over a norm that is never
        too large (it takes a subsequence that occurs twice in a word for two), what is left over the true one."""
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            raw = np.frombuffer(("\x00" * 4).join(part).encode("utf-32-le", "surrogatepass") + b"\0" * 16, np.uint32)
            code = self.code[raw]
            real = raw != 0
            word = np.repeat(np.arange(len(part)), [len(w) + 4 for w in part])
            energy, hits = np.zeros(len(part)), []
            for a, b in SKIPS:
                weight, n = DECAY ** (a + b - 2), len(raw) - a - b
                inside = real[:n] & real[a : a + n] & real[a + b :]
                energy += weight * weight * np.bincount(word[:n][inside], minlength=len(part))
                found = self._lookup(code[:n], code[a : a + n], code[a + b :])
                at = np.flatnonzero(inside & (found >= 0))
                hits.append((word[at], found[at], np.full(len(at), weight)))
            value = self._products(*(np.concatenate(h) for h in zip(*hits, strict=True)), len(part))
            chosen = np.flatnonzero((value.max(1) >= (FLOOR - 1e-4) * np.sqrt(energy)) & (energy > 0))
            if not len(chosen):
                continue
            kernel = value[chosen] / np.sqrt(self._energy(raw, real, word, chosen, len(part)))[:, None]
            rows, columns = np.nonzero(kernel >= FLOOR)
            ends = np.searchsorted(rows, np.arange(len(chosen) + 1))
            for j in np.flatnonzero(np.diff(ends)).tolist():
                at = columns[ends[j] : ends[j + 1]]
                yield part[chosen[j]], at, kernel[j, at]

    def _products(self, word: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """(n, landmarks): sums over the words' subsequences of their weights in the landmarks that have them, which are few."""
        counts = self.ends[key + 1] - self.ends[key]
        hit = np.repeat(np.arange(len(key)), counts)
        place = np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts) + self.ends[key][hit]
        return np.bincount(word[hit] * self.m + self.columns[place], weight[hit] * self.values[place], minlength=n * self.m).reshape(n, self.m)

    def _energy(self, raw: np.ndarray, real: np.ndarray, word: np.ndarray, chosen: np.ndarray, n_words: int) -> np.ndarray:
        """The squared norms of the chosen words: weights of equal subsequences of a word are added up before they are squared."""
        name = np.full(n_words, -1)
        name[chosen] = np.arange(len(chosen))
        own = name[word]
        keep = np.flatnonzero(real & (own >= 0))
        letters, small = np.unique(raw[keep], return_inverse=True)
        code = np.zeros(len(raw), np.int64)
        code[keep] = small
        keys, weights = [], []
        for a, b in SKIPS:
            n = len(raw) - a - b
            at = np.flatnonzero(real[:n] & real[a : a + n] & real[a + b :] & (own[:n] >= 0))
            keys.append(((own[at] * len(letters) + code[at]) * len(letters) + code[at + a]) * len(letters) + code[at + a + b])
            weights.append(np.full(len(at), DECAY ** (a + b - 2)))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(weight, starts)
        return np.bincount(key[starts] // len(letters) ** 3, total * total, minlength=len(chosen))

    def learn_words(self, tokens: set[str]) -> None:
        if len(self.far) + len(self.near) > CACHE:
            self.far.clear()
            self.near.clear()
        fresh = [t for t in tokens if t not in self.far and t not in self.near]
        if not fresh:
            return
        by: dict[str, list[str]] = {}
        for t in fresh:
            for w in forms(t):
                by.setdefault(w, []).append(t)
        self.far.update(fresh)
        for w, at, k in self._near([w for w in by if len(w) >= 3]):
            for t in by[w]:
                self.far.discard(t)
                if t in self.near:
                    both = np.zeros(self.m)
                    both[at] = k
                    both[self.near[t][0]] = np.maximum(both[self.near[t][0]], self.near[t][1])
                    self.near[t] = (some := np.flatnonzero(both)), both[some]
                else:
                    self.near[t] = at, k

    def features(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.m))
        step = 64
        for lo in range(0, len(texts), step):
            sets = [words_of(t) for t in texts[lo : lo + step]]
            self.learn_words(set().union(*sets))
            for i, words in enumerate(sets, lo):
                found = [self.near[w] for w in words if w in self.near]
                if found:
                    np.maximum.at(out[i], np.concatenate([at for at, _ in found]), np.concatenate([k for _, k in found]))
        return out


@lru_cache(maxsize=2)
def _featuriser(landmarks: tuple[str, ...]) -> Featuriser:
    """One for all tasks of a Python worker, so that words stay known."""
    return Featuriser(list(landmarks))


def _fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with a squared hinge: Newton steps over the rows inside the margin. y is +1 or -1; the labels weigh the same in sum."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    weight = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) * n / 2
    w, ridge = np.zeros(d + 1), np.diag([1.0] * d + [1e-6])
    for _ in range(rounds):
        inside = y * (a @ w) < 1
        s = a[inside] * (c * weight[inside])[:, None]
        new = np.linalg.solve(ridge + s.T @ a[inside], s.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the margin, by a few Newton steps with smoothed targets."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), a.T @ (p - target) + 1e-6 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Model:
    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, curve: tuple[float, float]):
        self.landmarks, self.weights, self.bias, self.curve = landmarks, weights, bias, curve

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each labelled row, counted by label within the batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            for w in {p for t in words_of(text.as_py()) for p in pieces(clean(t))}:
                if len(w) >= 3:  # a shorter word has no subsequence of three characters
                    counts.setdefault(w, [0, 0])[toxic.as_py()] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["word", "n1", "n0"])


def _choose(candidates: list[str], most: int) -> list[str]:
    """Down the list, words that no chosen landmark is already near to."""
    chosen: list[tuple[str, dict, float]] = []
    for w in candidates:
        row = profile(w)
        norm = np.sqrt(sum(v * v for v in row.values()))
        if norm and all(sum(v * r.get(k, 0.0) for k, v in row.items()) / (norm * m) < 0.85 for _, r, m in chosen):
            chosen.append((w, row, norm))
        if len(chosen) == most:
            break
    return [w for w, _, _ in chosen]


def draw(labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Rows of labels (doc_id, toxic 0/1, and more), about max_train of each label at most, drawn by a hash of the id."""
    labels = labels.where(F.col("toxic").isin(0, 1))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    bound = {k: int(min(1.0, max_train / n[k]) * (1 << 30)) if k in n else 0 for k in (0, 1)}
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    return labels.where(drawn < F.when(F.col("toxic") == 1, bound[1]).otherwise(bound[0]))


def train(labelled: DataFrame, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on rows (doc_id, text, toxic 0/1); about max_train rows of each label at most are used."""
    return fit(draw(labelled, max_train), landmarks)


def fit(sample: DataFrame, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on all rows (text, toxic 0/1) of a bounded sample, which is written first, as it is read three times."""
    sample, sample_at = written(sample.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    model = _fit(sample, landmarks)
    forget(sample.sparkSession, sample_at)
    return model


def _fit(sample: DataFrame, landmarks: int) -> Model | None:
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    counts = sample.mapInArrow(_words, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    lift = F.log((F.col("n1") + 0.5) / F.lit(n[1] + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n[0] + 1.0))
    ranked = counts.where("n1 >= 2").withColumn("z", lift / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))).where("z > 2")
    chosen = _choose([r["word"] for r in ranked.orderBy(F.desc("z"), "word").limit(CANDIDATES).collect()], landmarks)
    if not chosen:
        return None

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featuriser(chosen)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(f.features(batch.column(0).to_pylist())), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = sample.mapInArrow(featurise, "x array<double>, toxic int").toPandas()
    x, label = np.stack(rows["x"]), rows["toxic"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack([x, label]).T)  # one order whatever the partitions
    x, label = x[order], label[order]
    f = Featuriser(chosen)
    gram = np.stack([f.kernel(w) for w in chosen])
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    w, bias = _fit_svm(x @ whiten, 2 * label - 1)
    weights = whiten @ w
    return Model(chosen, weights, bias, _calibrate(x @ weights + bias, label))


def score_toxicity(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df with `score`, 0 to 1."""
    df = df.drop("score")
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    if model is None:
        return df.withColumn("score", F.lit(0.0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _featuriser(tuple(model.landmarks))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(f.features(part.column(at).to_pylist())))], [x.name for x in schema])

    return df.mapInArrow(work, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn, drawn_at = written(draw(labels.where(~held_out())), "toxicity-labels")
    model = fit(docs.join(broadcast_if(drawn, drawn.count(), 4 * MAX_TRAIN), "doc_id"))
    forget(spark, drawn_at)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
