"""Quality score: random-indexing word vectors, pooled, into a two-layer network.

Each token (a run without white space) has a sparse random index vector. The
context vector of a token sums the index vectors of its neighbours
within ``REACH`` tokens over the training sample; tokens seen there fewer than ``LEAST_COUNT`` times have none.
A second random-indexed vector stands for the token's shape (its character
classes, equal neighbours once, at whole length).  A document is the mean of its token vectors, with the
concentration of its tokens: the norms of the means, the share of tokens
equal to the one before, and of distinct tokens.  A network with one hidden layer
of ``HIDDEN`` units, trained in numpy, scores it; a temperature fitted on a
part of the sample kept back calibrates the probabilities.

Fitted on a sample of labelled documents bounded by ``SAMPLE_DOCS`` documents and
``SAMPLE_CHARS`` characters in the mean, of texts up to ``SAMPLE_TEXT`` characters each, drawn by a hash of doc_id; the bounds are
these parameters.  Of several texts with one doc_id the least one is learned from.  Scoring reads every whole text.

Defined results.  Null text counts as empty and gets the score of a
document without tokens.  Labels with null doc_id or quality are
ignored, of several for one doc_id the largest counts.  Without any label the
score is 0.5.  A score at ``CUTOFF`` (a tie) is predicted 1.  Repeated rows are scored row by row; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import id_crc

SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 24_000_000
SAMPLE_TEXT = 1_000_000
LEAST_COUNT = 2
REACH = 2
WORD_DIM = 32
SHAPE_DIM = 16
NONZERO = 4
HIDDEN = 24
EPOCHS = 120
CUTOFF = 0.3
CACHE_TOKENS = 150_000
_CLASS = {c: "a" for c in range(97, 123)} | {c: "A" for c in range(65, 91)} | {c: "0" for c in range(48, 58)}
_RUN = re.compile(r"(.)\1+", re.S)


def index_vector(key: str, size: int) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(key.encode("utf-8", "replace")))
    out = np.zeros(size, np.float32)
    out[rng.choice(size, NONZERO, replace=False)] = rng.choice((-1.0, 1.0), NONZERO)
    return out


def shape(token: str) -> str:
    plain = token.translate(_CLASS)
    if not plain.isascii():
        plain = "".join(("A" if c.isupper() else "a") if c.isalpha() else c for c in plain)
    return _RUN.sub(r"\1", plain)


class Vectors:
    """Token vectors: context part, then shape part."""

    def __init__(self, context: tuple[dict[str, int], np.ndarray]):
        self.words, self.context = context
        self.shapes: dict[str, np.ndarray] = {}
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, WORD_DIM + SHAPE_DIM), np.float32)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        fresh = set(tokens).difference(self.cache)
        for t in fresh:
            k = len(self.cache)
            if k == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            s = shape(t)
            if s not in self.shapes:
                self.shapes[s] = index_vector(s, SHAPE_DIM)
            self.rows[k, WORD_DIM:] = self.shapes[s]
            at = self.words.get(t)
            self.rows[k, :WORD_DIM] = 0.0 if at is None else self.context[at]
            self.cache[t] = k
        return np.fromiter(map(self.cache.__getitem__, tokens), np.int64, len(tokens))

    def features(self, text: str) -> np.ndarray:
        if len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
            self.shapes.clear()
        tokens = text.split()
        out = np.zeros(WORD_DIM + SHAPE_DIM + 5)
        if not tokens:
            return out
        at = self.numbers(tokens)
        total = np.zeros(WORD_DIM + SHAPE_DIM)
        for lo in range(0, len(at), 1 << 15):
            total += self.rows[at[lo : lo + (1 << 15)]].sum(axis=0)
        mean = total / len(at)
        out[: len(mean)] = mean
        out[-5] = np.linalg.norm(mean[:WORD_DIM])
        out[-4] = np.linalg.norm(mean[WORD_DIM:])
        out[-3] = float((at[1:] == at[:-1]).mean()) if len(at) > 1 else 0.0
        out[-2] = len(np.unique(at)) / len(at)
        out[-1] = np.log1p(len(at))
        return out


def context_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Row numbers of the tokens of texts, and their context vectors at unit length."""
    counts = Counter(t for x in texts for t in x.split())
    vocabulary = {t: k for k, t in enumerate(sorted(t for t, n in counts.items() if n >= LEAST_COUNT))}
    if not vocabulary:
        return {}, np.zeros((0, WORD_DIM), np.float32)
    # The index vectors as places and signs of their nonzero entries; the last row is that of other tokens.
    dense = np.stack([index_vector("w" + t, WORD_DIM) for t in vocabulary])
    places = np.argsort(-np.abs(dense), axis=1, kind="stable")[:, :NONZERO]
    signs = np.concatenate((np.take_along_axis(dense, places, axis=1), np.zeros((1, NONZERO))))
    places = np.concatenate((places, np.zeros((1, NONZERO), np.int64)))
    size = (len(vocabulary) + 1) * WORD_DIM
    out = np.zeros(size)
    for lo in range(0, len(texts), 256):
        # Separated by tokens that carry nothing, so that no neighbours cross texts.
        gap = [""] * REACH
        joined = [t for x in texts[lo : lo + 256] for t in (*x.split(), *gap)]
        at = np.fromiter((vocabulary.get(t, len(vocabulary)) for t in joined), np.int64, len(joined))
        for k in range(1, REACH + 1):
            for own, other in ((at[k:], at[:-k]), (at[:-k], at[k:])):
                spots = own[:, None] * WORD_DIM + places[other]
                out += np.bincount(spots.ravel(), weights=signs[other].ravel(), minlength=size)
    out = out.reshape(-1, WORD_DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return vocabulary, (out / np.maximum(norm, 1e-9)).astype(np.float32)[: len(vocabulary)]


class Net:
    """Two layers, tanh and logistic, with input scaling and a temperature."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.shift, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.shift) / self.scale) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> None:
        """Train on the rows outside kept, calibrate on kept."""
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        train = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(x))
        rng, m, v, step = np.random.default_rng(7), [0] * 4, [0] * 4, 0
        z = (x - self.shift) / self.scale
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
                a, b = z[part], y[part]
                h = np.tanh(a @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30)))
                d = (p - b) / len(part)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if kept.any():
            logit, truth = self.logits(x[kept]), y[kept]
            grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, logit / t) - truth * logit / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, context: tuple[dict[str, int], np.ndarray] | None, net: Net | None):
        self.context, self.net, self.vectors = context, net, None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), 0.5)
        if self.vectors is None:
            self.vectors = Vectors(self.context)
        if not texts:
            return np.zeros(0)
        return self.net.proba(np.stack([self.vectors.features(t or "") for t in texts]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample of docs that labels covers."""
    truth = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("y"))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_TEXT)
    sizes = rows.select("id", F.length("text").alias("n")).join(truth, "id").agg(F.count("*"), F.sum("n")).first()
    if not sizes[0]:
        return Model(None, None)
    share = min(1.0, SAMPLE_DOCS / sizes[0], SAMPLE_CHARS / max(1, sizes[1] or 1))

    def drawn(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 20)) < share * (1 << 20))

    sample = drawn(rows).join(drawn(truth), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = sample.toPandas().sort_values("id")
    if sample["y"].nunique() < 2:
        return Model(None, None)
    texts = [t or "" for t in sample["text"]]
    context = context_vectors(texts)
    vectors = Vectors(context)
    x = np.stack([vectors.features(t) for t in texts])
    kept = np.array([zlib.crc32(str(i).encode()) // 5 % 5 == 1 for i in sample["id"]])
    net = Net(x.shape[1])
    net.fit(x, sample["y"].to_numpy(float), kept)
    return Model(context, net)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted; held_out has to be in docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            # Nine digits: the same whatever texts share a batch.
            score = np.round(sent.value.scores(pdf["text"].tolist()), 9)
            yield pd.DataFrame(
                {"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": score, "predicted": (score >= CUTOFF).astype(np.int32)}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the documents whose crc32 of doc_id mod 5 is not 0, score all."""
    held = id_crc() % 5 == 0
    model = fit(docs.where(~held), labels)
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model)
