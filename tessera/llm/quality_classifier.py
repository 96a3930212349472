"""Quality classifier (8): supervised subword embeddings with softmax output, trained by numpy gradient descent.

A text is the mean of learned vectors of its hashed words and character n-grams. The output layer is linear, so after
training each hash bucket has one number, its share in the difference of the two logits; scoring a text is a sum over
its features. The model learns from a bounded sample of labelled rows, drawn by a hash of the id and balanced by
label; the share of each label among all learnable rows then sets the prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
LEAST_STEPS = 4000
PIECE = 500_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words and character n-grams of some texts, and the index of the text each is of.

    Words are what white space separates; n-grams of a word take in the blank before and after it.
    """
    codes = [common.code_points(t) for t in texts]
    length = np.array([len(c) + 2 for c in codes], np.int64)
    blank = np.full(1, 32, np.uint32)
    c = np.concatenate([x for one in codes for x in (blank, one, blank)]) if codes else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    space = np.isin(c, BLANKS)
    c = np.where(space, np.uint32(32), c).astype(np.uint64)
    inner = np.append(0, np.cumsum(space))
    found, owners = [], []
    with np.errstate(over="ignore"):
        h = c.copy()
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * PRIME + c[n - 1 :]
            if n in GRAMS and len(h):
                ok = inner[n - 1 : n - 1 + len(h)] == inner[1 : 1 + len(h)]
                found.append(common.mix64(h[ok] + np.uint64(n)))
                owners.append(owner[: len(h)][ok])
        starts = np.flatnonzero(~space & np.append(True, space[:-1]))
        if len(starts):
            word = np.cumsum(~space & np.append(True, space[:-1])) - 1
            letters = np.flatnonzero(~space)
            place = letters - starts[word[letters]]
            powers = np.cumprod(np.full(int(place.max()) + 1, PRIME, np.uint64))
            first = np.flatnonzero(np.append(True, word[letters][1:] != word[letters][:-1]))
            found.append(common.mix64(np.add.reduceat((c[letters] + np.uint64(1)) * powers[place], first)))
            owners.append(owner[starts])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def pieces(text: str) -> list[str]:
    """A very long text in parts, cut before white space where there is some near."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at + PIECE // 2, at + PIECE), text.rfind("\n", at + PIECE // 2, at + PIECE))
        cut = at + PIECE if cut < 0 else cut
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


class Classifier:
    """Two-label subword model."""

    def __init__(self, dim: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        self.out = np.zeros((dim, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.rng = rng

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 6, rate: float = 0.6) -> Classifier:
        """bags: distinct buckets and counts of each text. Plain stochastic descent with a linearly falling rate; few
        texts are gone through more often, to LEAST_STEPS steps in all."""
        epochs = max(epochs, -(-LEAST_STEPS // max(1, len(bags))))
        steps, done = epochs * len(bags), 0
        for _ in range(epochs):
            for i in self.rng.permutation(len(bags)):
                buckets, counts = bags[i]
                lr, done = rate * (1 - done / steps), done + 1
                if not len(buckets):
                    continue
                w = (counts / counts.sum()).astype(np.float32)
                hidden = w @ self.vectors[buckets]
                z = hidden @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.out @ p
                self.out -= lr * np.outer(hidden, p)
                self.bias -= lr * p * 0.1
                self.vectors[buckets] -= (lr * len(buckets) ** 0.5) * np.outer(w, back)
        return self

    def weights(self) -> np.ndarray:
        """What each bucket adds to the logit of label 1 against label 0."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def scores(texts: list[str], weights: np.ndarray, offset: float) -> np.ndarray:
    """Probability of label 1 of each whole text; a text without words gets the offset's alone."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        found = pieces(t)
        parts += found
        owner += [i] * len(found)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    owner = np.array(owner, np.int64)
    for a, b in common.blocks_of([len(p) for p in parts], PIECE):
        bucket, part = features(parts[a:b])
        total += np.bincount(owner[a:b][part], weights[bucket], len(texts))
        count += np.bincount(owner[a:b][part], minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + offset)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text with their counts; at most BUCKETS of them, however long the text."""
    for batch in batches:
        for row_id, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = np.zeros(BUCKETS, np.int32)
            for part in pieces(text or ""):
                total += np.bincount(features([part])[0], minlength=BUCKETS).astype(np.int32)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row_id], pa.int64()), pa.array([label], pa.int32()), pa.array([at.astype("<i4").tobytes()]), pa.array([total[at].astype("<i4").tobytes()])],
                ["doc_id", "label", "buckets", "counts"],
            )


def train(docs: DataFrame, labels: DataFrame, max_per_label: int = 700, learnable=None) -> tuple[np.ndarray, float]:
    """Weights and offset of a model fitted on at most max_per_label texts of each label.

    labels: (doc_id, quality); rows without a label are left out, and of several labels of one id the largest counts. Of
    several rows of one id one is learned, that with the text of the smallest hash. learnable: a condition on doc_id. Without rows of both labels the score is the share of label 1 (one half of none).
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    known = known.where(learnable) if learnable is not None else known
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 0.5)))
    if len(share) < 2:
        return np.zeros(BUCKETS, np.float32), prior
    some = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_label) for k in (0, 1)]
    ids = some[0].unionByName(some[1])  # at most twice max_per_label ids
    texts = common.drawn(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id"), "label", max_per_label, F.xxhash64("doc_id"))
    found = texts.select("doc_id", "label", "text").mapInArrow(common.trimmed(_bags), "doc_id long, label int, buckets binary, counts binary").toPandas().sort_values("doc_id", ignore_index=True)
    bags = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4")) for b, c in zip(found["buckets"], found["counts"], strict=True)]
    model = Classifier().fit(bags, found["label"].tolist())
    drawn = float(np.log((found["label"].eq(1).sum() + 0.5) / (found["label"].eq(0).sum() + 0.5)))
    return model.weights(), model.offset() + prior - drawn


def score_documents(docs: DataFrame, weights: np.ndarray, offset: float) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier), predicted. Null counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores([t or "" for t in batch.column(1).to_pylist()], held.value, offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.trimmed(run), "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, held_mod: int = 3, held_rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learns only from ids that aren't held out.

    Repeated rows each give a row, an empty table gives none, and other columns of docs have no influence.
    """
    rest = common.crc_mod("doc_id", held_mod)
    weights, offset = train(docs, labels, learnable=rest != held_rest)
    out = score_documents(docs, weights, offset)
    return out.select("doc_id", F.coalesce(rest == held_rest, F.lit(False)).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, held_mod: int = 3, held_rest: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, whose score is least or more. Learns as quality_scores does."""
    weights, offset = train(docs, labels, learnable=common.crc_mod("doc_id", held_mod) != held_rest)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores([t or "" for t in batch.column(at).to_pylist()], held.value, offset)
            yield batch.filter(pa.array(s >= least, pa.bool_()))

    return docs.mapInArrow(common.trimmed(run), docs.schema)
