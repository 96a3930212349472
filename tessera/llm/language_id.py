"""Language ID (3): a byte convolutional network, trained in numpy and applied to fixed-length windows.

Each window of WINDOW bytes passes an embedding, filters of several widths, max pooling and softmax. For prediction
the embedding and the filters are folded into tables over single bytes and byte pairs, so a filter response is one or
two table rows. A text's posterior is the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
UNKNOWN = "und"
#: A letter is a character of a Unicode category L; this finds where one may be, and numerals such as ½ or Ⅷ besides.
MAYBE = re.compile(r"[^\W\d_]")
#: Windows that pass the network at once.
BLOCK = 128


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in MAYBE.finditer(text or ""))


class ByteCnn:
    """Embedding, convolutions of three widths, max pooling, softmax; Adam on the cross entropy."""

    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes, self.rng = classes, rng
        self.p = {"e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "u": np.zeros((len(WIDTHS) * FILTERS, len(classes)), np.float32), "c": np.zeros(len(classes), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of one batch of windows."""
        p, n = self.p, len(x)
        emb = p["e"][x]
        pooled, where = [], []
        for w in WIDTHS:
            flat = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(n * (WINDOW - w + 1), w * DIM)
            z = (flat @ p[f"w{w}"]).reshape(n, WINDOW - w + 1, FILTERS) + p[f"b{w}"]
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
            where.append(at)
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        z = a @ p["u"] + p["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"u": a.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        back = (q @ p["u"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            place = where[k][:, :, None] + np.arange(w)
            bytes_at = x[np.arange(n)[:, None, None], place]
            patch = p["e"][bytes_at].reshape(n, FILTERS, w * DIM)
            g[f"w{w}"] = np.einsum("nfp,nf->pf", patch, d, optimize=True)
            g[f"b{w}"] = d.sum(0)
            into = (d[:, :, None] * p[f"w{w}"].T).reshape(-1, DIM)
            flat = bytes_at.reshape(-1)
            for j in range(DIM):
                g["e"][:, j] += np.bincount(flat, into[:, j], 256)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01) -> ByteCnn:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, epochs * max(1, -(-len(x) // batch))
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), batch):
                take = order[at : at + batch]
                t += 1
                lr = rate * (1 - 0.9 * t / steps)
                for k, g in self._step(x[take], y[take]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """The filters as tables: for each width, responses to byte pairs and, for an odd width, to its last byte."""
        out = {"u": self.p["u"], "c": self.p["c"]}
        for w in WIDTHS:
            one = [self.p["e"] @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM] for j in range(w)]
            one[0] = one[0] + self.p[f"b{w}"]
            for j in range(0, w - 1, 2):
                out[f"{w}.{j}"] = (one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32)
            if w % 2:
                out[f"{w}.{w - 1}"] = one[w - 1].astype(np.float32)
        return out


def posteriors(windows: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
    """Class probabilities of (n, WINDOW) bytes."""
    out = []
    for at in range(0, len(windows), BLOCK):
        x = windows[at : at + BLOCK].astype(np.int32)
        pair = x[:, :-1] * 256 + x[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = tables[f"{w}.0"][pair[:, :n]]
            for j in range(2, w, 2):
                z += tables[f"{w}.{j}"][pair[:, j : j + n]] if j + 1 < w else tables[f"{w}.{j}"][x[:, j : j + n]]
            pooled.append(z.max(1))
        z = np.maximum(np.concatenate(pooled, 1), 0) @ tables["u"] + tables["c"]
        q = np.exp(z - z.max(1, keepdims=True))
        out.append(q / q.sum(1, keepdims=True))
    return np.concatenate(out) if out else np.zeros((0, len(tables["c"])))


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text's bytes, the last one filled with zeros, and the bytes in each."""
    n = max(1, -(-len(data) // WINDOW))
    x = np.zeros(n * WINDOW, np.uint8)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    size = np.full(n, WINDOW)
    size[-1] = len(data) - (n - 1) * WINDOW
    return x.reshape(n, WINDOW), size


def predict(texts: list[str | None], tables: dict[str, np.ndarray], classes: list[str]) -> tuple[list[str], list[float]]:
    langs, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if has_letter(t)] if classes else []
    data = [texts[i].encode("utf-8", "replace") for i in todo]
    total = np.zeros((len(todo), len(classes)))
    for a, b in common.blocks_of([len(d) for d in data], 1 << 22):
        cut = [windows_of(d) for d in data[a:b]]
        owner = np.repeat(np.arange(a, b), [len(s) for _, s in cut])
        q = posteriors(np.concatenate([x for x, _ in cut]), tables) * np.concatenate([s for _, s in cut])[:, None]
        for k in range(len(classes)):
            total[:, k] += np.bincount(owner, q[:, k], len(todo))
    for j, i in enumerate(todo):
        k = int(total[j].argmax())
        langs[i], sure[i] = classes[k], float(min(1.0, total[j, k] / max(1, len(data[j]))))
    return langs, sure


def _drawn(per_doc: int):
    """At most per_doc windows of each text, spread evenly over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    x, _ = windows_of(text.encode("utf-8", "replace"))
                    for at in np.unique(np.linspace(0, len(x) - 1, per_doc).astype(int)):
                        out.append((row_id, int(at), lang, x[at].tobytes()))
            if out:
                i, at, lang, x = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(at, pa.int32()), pa.array(lang), pa.array(x, pa.binary())], ["doc_id", "at", "lang", "x"])

    return run


def train(docs: DataFrame, max_docs: int = 500, per_doc: int = 4, learnable=None) -> tuple[dict[str, np.ndarray], list[str]]:
    """Tables and language names of a network fitted on about max_docs texts of each language, however many there are, and
    on twice as many at most.

    Ids are drawn by a hash, with one text of an id and language and per_doc windows of it; languages that the draw leaves
    out have their text of the smallest hash. learnable: a condition on the rows of docs.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").where("lang is not null and text is not null and doc_id is not null")
    rows = rows.where(learnable) if learnable is not None else rows
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("low")).orderBy("lang").collect()
    if not counts:
        return ByteCnn([]).tables(), []
    share = docs.sparkSession.createDataFrame([(r["lang"], max(min(1.0, max_docs / r["n"]) * (1 << 20), r["low"] + 1.0)) for r in counts], "lang string, share double")
    some = common.drawn(rows.join(F.broadcast(share), "lang").where(place < F.col("share")), "lang", 2 * max_docs, place)
    found = some.select("doc_id", "lang", "text").mapInArrow(_drawn(per_doc), "doc_id long, at int, lang string, x binary").toPandas()
    found = found.sort_values(["doc_id", "at", "lang"], ignore_index=True)
    classes = sorted(found["lang"].unique().tolist())
    x = np.frombuffer(b"".join(found["x"]), np.uint8).reshape(-1, WINDOW)
    y = found["lang"].map({c: k for k, c in enumerate(classes)}).to_numpy(np.int64)
    model = ByteCnn(classes)
    return (model.fit(x, y) if len(x) else model).tables(), classes


def identify(docs: DataFrame, held_mod: int = 4, held_rest: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are 'und' with score 0, and so are all texts where no row can be learned
    from. lang, source and doc_id have no part in a prediction; repeated rows each give a row.
    """
    rest = common.crc_mod("doc_id", held_mod)
    tables, classes = train(docs, learnable=rest != held_rest)
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sure = predict(batch.column(1).to_pylist(), held.value, classes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(rest == held_rest, F.lit(False)).alias("held_out"), "lang_pred", "score")
