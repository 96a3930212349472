"""Mixing sources to target weights (2): soft membership and projected-gradient least squares.

A softmax classifier, trained on a labelled table, gives every document a posterior over domains by its words alone:
where a document comes from, its labels and its id have no part in a prediction. The rates of documents
are the nonnegative numbers nearest to a target in the least-squares sense: with n_i tokens and posterior p_i, the
expected tokens of domain d are sum(n_i * p_id * r_i), and the squared relative distances of these from the targets
are made small by projected gradient steps r <- max(0, y - step * p . residual(y)), from r = 1, where y carries r on in
the direction of its last change (Nesterov's momentum, begun anew when the squares grow).

A step is one sum over the documents, partition by partition. The residuals of all steps so far, a short list of
numbers for each domain, determine a document's rate; so rates are computed where they are needed, from a table of
posteriors that is written once, and nothing that grows with the documents comes to the driver.

Rates become whole copies by a hash of the id. A domain's documents differ in length by orders of magnitude, so its drawn
tokens would stray from its target; a histogram of the documents' distances from being rounded up, weighted by tokens,
tells by how much the domain's rounding limit has to move for the drawn tokens to meet the rates'.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.minhash_dedup import word_hashes

BUCKETS = 1 << 15
OTHER = "other"
#: Bins of the histogram that rounding limits are taken from.
BINS = 4096
#: About so many rows of each domain are learned from, if there are so many.
LEAST = 16
#: A target is missed when the expected tokens are off by more than this share of it.
MISSED = 0.01


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = word_hashes(texts)
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), counts


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, domain, buckets, counts) of (doc_id, domain, text): at most BUCKETS numbers a text."""
    for batch in batches:
        for i, domain, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, n = np.unique(_tokens([(text or "").encode("utf-8", "surrogatepass")])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([domain]), pa.array([at.astype("<i4").tobytes()]), pa.array([n.astype("<i4").tobytes()])], ["doc_id", "domain", "buckets", "counts"])


def train(docs: DataFrame, labelled: DataFrame, max_docs: int = 2000, epochs: int = 8, rate: float = 2.0) -> tuple[np.ndarray, list[str]]:
    """(weights, domains) of a softmax over mean word vectors.

    labelled: (doc_id, domain); of several domains of an id the smallest counts. Every domain is learned: from its part of
    about max_docs ids, or about LEAST if these are more, drawn by a hash, and one in any case; no domain gives more than
    twice max_docs rows. Of several rows of one id one is learned, that with the text of the smallest hash.
    """
    known = labelled.select("doc_id", "domain").where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = known.groupBy("domain").agg(F.count("*").alias("n"), F.min(place).alias("low")).collect()
    count = {r["domain"]: r["n"] for r in drawn}
    if not count:
        return np.zeros((BUCKETS + 1, 1), np.float32), [OTHER]
    domains = sorted(count)
    total = sum(count.values())
    limits = [(r["domain"], max((1 << 30) * min(1.0, max(max_docs / total, LEAST / r["n"])), r["low"] + 1.0)) for r in drawn]
    limits = docs.sparkSession.createDataFrame(limits, "domain string, below double")
    ids = known.join(F.broadcast(limits), "domain").where(place < F.col("below")).select("doc_id", "domain")
    rows = common.drawn(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id"), "domain", 2 * max(max_docs, LEAST), F.xxhash64("doc_id"))
    found = rows.select("doc_id", "domain", "text").mapInArrow(common.trimmed(_bags), "doc_id long, domain string, buckets binary, counts binary").toPandas()
    found = found.sort_values(["doc_id", "domain"], ignore_index=True)
    index = {d: k for k, d in enumerate(domains)}
    y = [index[d] for d in found["domain"]]
    w = np.zeros((BUCKETS + 1, len(domains)), np.float32)
    n = np.array([count[d] for d in domains])
    w[-1] = np.log((n + 0.5) / (n.sum() + 0.5))
    rng, steps, done = np.random.default_rng(3), epochs * len(found), 0
    bags = [(np.frombuffer(b, "<i4"), np.frombuffer(c, "<i4").astype(np.float32)) for b, c in zip(found["buckets"], found["counts"], strict=True)]
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            at, n = bags[k]
            lr, done = rate * (1 - done / steps), done + 1
            share = n / max(n.sum(), 1)
            z = share @ w[at] + w[-1]
            q = np.exp(z - z.max())
            q /= q.sum()
            q[y[k]] -= 1
            w[at] -= lr * np.outer(share, q) / max(float(share @ share), 0.05)
            w[-1] -= 0.02 * lr * q
    return w, domains


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, p): the posterior of each row over the domains, by its words."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in common.blocks_of([len(t) for t in texts], 1 << 20):
                at, n = _tokens(texts[a:b])
                z = np.repeat(w[-1][None, :], b - a, 0).astype(np.float64)
                owner = np.repeat(np.arange(b - a), n)
                for lo in range(0, len(at), 200_000):
                    for d in range(w.shape[1]):
                        z[:, d] += np.bincount(owner[lo : lo + 200_000], w[at[lo : lo + 200_000], d], b - a) / np.maximum(n, 1)
                q = np.exp(z - z.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * w.shape[1], pa.int32()), pa.array(q.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), flat], ["doc_id", "n_tokens", "p"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.trimmed(run), "doc_id long, n_tokens long, p array<double>")


def _rates(p: np.ndarray, pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rates after all steps so far, and these carried on. pulls: what each step subtracts for each domain, and
    whether momentum begins anew before it."""
    r = y = np.ones(len(p))
    t = 1.0
    for pull, anew in zip((p @ pulls[:, :-1].T).T if len(pulls) else (), pulls[:, -1], strict=True):
        if anew:
            y, t = r, 1.0
        new = np.maximum(0, y - pull)
        ahead = (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, y, t = new, new + (t - 1) / ahead * (new - r), ahead
    return r, y


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(pulls: np.ndarray, second: bool):
    """Sums of a partition: expected tokens of each domain at the present rates and at these carried on, and on demand the
    second moments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                n, p = batch.column(0).to_numpy().astype(np.float64), _matrix(batch.column(1))
                part = np.concatenate([(n * r) @ p for r in _rates(p, pulls)])
                part = np.concatenate([part, ((p * n[:, None]).T @ p).reshape(-1)]) if second else part
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "x"])

    return run


def _summed(table: DataFrame, pulls: np.ndarray, second: bool, size: int) -> np.ndarray:
    """The sums over all rows; size: the number of domains."""
    out = np.zeros(2 * size + (size * size if second else 0))
    for r in table.select("n_tokens", "p").mapInArrow(common.trimmed(_sums(pulls, second)), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


def fit(table: DataFrame, domains: int, weights: np.ndarray, total: float | None = None, steps: int = 40, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pulls, reached, targets): projected-gradient steps until every domain is within close of its target, or all done.
    While a target is missed, steps go on as long as ten of them bring the worst domain nearer by a tenth.

    weights: the share of each domain; total: expected tokens of the mixture. Without it, the least total at which no
    domain has to give tokens up.
    """
    first = _summed(table, np.zeros((0, domains + 1)), True, domains)
    now, ahead, moments = first[:domains], first[domains : 2 * domains], first[2 * domains :].reshape(domains, domains)
    share = weights / weights.sum()
    total = float(np.max(np.where(share > 0, now / np.maximum(share, 1e-300), 0))) if total is None else total
    targets = share * total
    scale = 1 / np.maximum(targets, 1e-9 * max(total, 1))
    root = np.sqrt(scale)
    top = float(np.linalg.eigvalsh(root[:, None] * moments * root[None, :])[-1])
    pulls = np.zeros((0, domains + 1))
    worst, squares = [], [np.inf]
    while top > 0:
        off = (now - targets) * scale
        worst.append(float(np.abs(off).max()))
        squares.append(float((off * off / scale).sum()))
        if worst[-1] <= close or (len(pulls) >= steps and (worst[-1] <= MISSED or min(worst[-10:]) > 0.9 * min(worst[:-10]))):
            break
        anew = squares[-1] > squares[-2]
        pull = ((now if anew else ahead) - targets) * scale / top
        pulls = np.concatenate([pulls, np.append(pull, anew)[None, :]])
        sums = _summed(table, pulls, False, domains)
        now, ahead = sums[:domains], sums[domains:]
    return pulls, now, targets


def _applied(pulls: np.ndarray, domains: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(2)) if batch.num_rows else np.zeros((0, len(domains)))
            top = p.argmax(1) if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([domains[k] for k in top], pa.string()), pa.array(np.round(p[np.arange(len(p)), top], 6)), pa.array(np.round(_rates(p, pulls)[0], 6))],
                ["doc_id", "n_tokens", "domain", "posterior", "rate"],
            )

    return run


def _limits(rated: DataFrame) -> dict[str, float]:
    """For each domain the limit at which the tokens of documents that are rounded up add up to the tokens that their
    rates have beyond whole copies: a document goes up if chance - fraction is below it."""
    bins = rated.groupBy("domain", F.floor((F.col("chance") - F.col("part") + 1) / 2 * BINS).alias("bin")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("part")).alias("want"))
    held: dict[str, list] = {}
    for r in bins.collect():  # domains times BINS rows at most
        held.setdefault(r["domain"], []).append((r["bin"], r["n"], r["want"]))
    out = {}
    for domain, rows in held.items():
        rows.sort()
        at, n, want = (np.array(x, float) for x in zip(*rows, strict=True))
        before = np.cumsum(n) - n
        k = int(np.searchsorted(before + n, want.sum()))
        if k == len(n):
            out[domain] = 1.0
        else:  # within a bin, documents are taken as evenly spread
            out[domain] = 2 * (at[k] + (want.sum() - before[k]) / max(n[k], 1)) / BINS - 1
    return out


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None, keep_all: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain, posterior, rate, copies.

    targets: weights of domains; without them the domains' expected tokens to the power temperature, so that small
    domains get more. total: tokens of the mixture; without it, as many as there are, or with keep_all the least total at
    which no domain has to give tokens up. copies is the rate rounded down or up by a hash of the id, so that the tokens
    of each domain's copies are those of its rates; with keep_all it is 1 at least. Null texts are empty and have no
    tokens. With no labelled row there is one domain, and all rates are 1. Repeated rows each give a row; an empty table
    gives none. Targets that the fit misses, or that are of domains without a labelled row, are told in a warning.
    """
    weights, domains = train(docs, labelled)
    table = common.written(posteriors(docs, weights), "posteriors")
    first = _summed(table, np.zeros((0, len(domains) + 1)), False, len(domains))[: len(domains)]
    wanted = np.maximum(first, 0) ** temperature if targets is None else np.array([targets.get(d, 0.0) for d in domains])
    missed = [f"{d}: no labelled row" for d in sorted(set(targets or {}) - set(domains))]
    pulls = np.zeros((0, len(domains) + 1))
    if wanted.sum() > 0:
        pulls, reached, goals = fit(table, len(domains), wanted, float(first.sum()) if total is None and not keep_all else total)
        off = np.abs(reached - goals) > MISSED * np.maximum(goals, 1e-9 * max(goals.sum(), 1))
        missed += [f"{domains[k]}: {reached[k]:.0f} of {goals[k]:.0f} tokens" for k in np.flatnonzero(off)]
    if missed:
        warnings.warn("mixing targets missed: " + "; ".join(missed), stacklevel=2)
    rated = common.written(table.mapInArrow(common.trimmed(_applied(pulls, domains)), "doc_id long, n_tokens long, domain string, posterior double, rate double"), "rates")
    common.dropped(table)
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rated = rated.withColumn("chance", chance).withColumn("part", F.col("rate") - F.floor("rate"))
    limits = _limits(rated)
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("domain")) if limits else F.lit(0.0)
    up = (F.col("part") > 0) & (F.col("chance") - F.col("part") < limit)
    copies = F.floor("rate") + F.when(up, 1).otherwise(0)
    out = rated.withColumn("copies", (F.greatest(copies, F.lit(1)) if keep_all else copies).cast("long"))
    return out.drop("chance", "part")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the registered query: (doc_id, domain) of documents that labels covers. The domain is the
    language and the quality mark, such as en/1, which a text can tell."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long")).agg(F.min("quality").cast("string").alias("mark"))
    named = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang")).where("lang is not null")
    return named.join(known.hint("merge"), "doc_id").select("doc_id", F.concat_ws("/", "lang", "mark").alias("domain"))
