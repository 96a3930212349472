"""Ranked lexical search (11): block-max pruning over a forward index.

The index is a table of blocks. A block holds the documents of a short range of the table, each as its distinct terms with
their counts (a forward index), and for every term of the block the number of its documents and the largest share that it
adds to any of their scores. Blocks are made where the documents are read, so no text is shuffled.

A search adds up, block by block, the largest shares of an item's terms: a bound that no document of the block exceeds.
The few blocks with the largest bounds of all are scored first; their k-th score is a threshold that every task then
starts from. A task takes its blocks by falling bound and scores their documents until the bound drops below the
threshold, which rises with what the task finds. A block whose bound equals it is left out only if all its ids are behind
the k-th one's. So nothing of the result is lost, whatever the bounds are worth; what a task sends on is k rows an item.

Items are the query set: they are counted, and go in groups of a bounded size, each broadcast to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: A term: a run of 0-9, A-Z, a-z and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: In UTF-8 all bytes of the latter are over 127: the others become blanks, A-Z become a-z.
BYTES = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Documents and bytes of text of a block; a longer text has a block of its own.
DOCS, TEXT = 128, 1 << 20
#: Blocks that are scored first for an item, and blocks of an Arrow batch.
FIRST, BATCH = 4, 16
#: Items of a group, and bytes of their texts.
ITEMS, ITEM_BYTES = 1000, 4 << 20
#: Rows of texts in an Arrow batch, and bytes of a row group of blocks: what a task holds, however large its input.
TEXTS, GROUP = 8 * DOCS, 8 << 20
#: Stands for a null id, behind all others.
LAST = np.int64(2**63 - 1)
BLOCK = "block long, low long, ids array<long>, m array<long>, terms array<binary>, dfs array<int>, tops array<long>, starts array<int>, term array<int>, tf array<int>"
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What tf occurrences add to a score, for a weight of 1."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Index:
    """blocks: the table; n_docs: documents with a term; n_terms: all their terms."""

    def __init__(self, blocks: DataFrame, n_docs: int, n_terms: int):
        self.blocks, self.n_docs, self.n_terms = blocks, n_docs, n_terms


def _block(number: int, ids: list[int | None], counts: list[Counter], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The row of a block, its documents by rising id."""
    order = sorted(range(len(ids)), key=lambda k: LAST if ids[k] is None else ids[k])
    ids, counts = [ids[k] for k in order], [counts[k] for k in order]
    place: dict[bytes, int] = {}
    term = np.array([place.setdefault(t, len(place)) for c in counts for t in c], np.int64)
    tf = np.array([x for c in counts for x in c.values()], np.int64)
    names = sorted(place)
    rank = np.empty(len(names), np.int64)
    rank[[place[t] for t in names]] = np.arange(len(names))
    term = rank[term]
    m = np.array([75 + (25 * sum(c.values()) * n_docs) // n_terms for c in counts], np.int64)
    size = [len(c) for c in counts]
    tops = np.zeros(len(names), np.int64)
    np.maximum.at(tops, term, share(tf, np.repeat(m, size)))
    ints = {"dfs": np.bincount(term, minlength=len(names)), "starts": np.cumsum([0, *size]), "term": term, "tf": tf}
    longs = {"m": m, "tops": tops}
    low = LAST if ids[0] is None else ids[0]
    columns = {"block": pa.array([number], pa.int64()), "low": pa.array([low], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "terms": pa.array([names], pa.list_(pa.binary()))}
    columns |= {k: pa.array([x], pa.list_(pa.int64())) for k, x in longs.items()} | {k: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for k, x in ints.items()}
    names = [f.split()[0] for f in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def _totals(rows: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms: a sum for each task goes to the driver's one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            sizes = [len(terms_of(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            docs, terms = docs + len(sizes) - sizes.count(0), terms + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["docs", "terms"])

    found = rows.mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a table as a written table of blocks. Rows without a term are in no block and count nowhere."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    with small_batches(docs.sparkSession, TEXTS):
        return _built(rows)


def _built(rows: DataFrame) -> Index:
    n_docs, n_terms = _totals(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for a, b in common.blocks_of([max(n, TEXT // DOCS) for n in pc.binary_length(texts).to_pylist()], TEXT):
                counts = [Counter(terms_of(t)) for t in texts.slice(a, b - a).to_pylist()]
                held = [k for k, c in enumerate(counts) if c]
                if held:
                    yield _block(number, [ids[a + k] for k in held], [counts[k] for k in held], n_docs, n_terms)
                    number += 1

    blocks = rows.mapInArrow(run, BLOCK)
    spark = rows.sparkSession
    return Index(common.written(blocks if n_docs else spark.createDataFrame([], BLOCK), "blocks", GROUP), n_docs, n_terms)


class Items:
    """A group of items: the sorted terms of all, and each item's places among them with its weights."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        counts: dict[int | None, Counter] = {}
        for item, texts in rows:
            counts[item] = sum((Counter(terms_of(t)) for t in texts), Counter())
        self.ids = list(counts)
        self.names = sorted({t for c in counts.values() for t in c})
        place = {t: k for k, t in enumerate(self.names)}
        self.term = np.array([place[t] for c in counts.values() for t in c], np.int64)
        self.times = np.array([n for c in counts.values() for n in c.values()], np.int64)
        self.starts = np.cumsum([0, *map(len, counts.values())])
        self.weights = np.zeros(len(self.term), np.int64)

    def weigh(self, dfs: dict[int, int], n_docs: int) -> Items:
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * dfs[k] + 1))) if k in dfs else 0 for k in range(len(self.names))], np.int64)
        self.weights = self.times * w[self.term]
        return self

    def terms(self) -> pa.Array:
        return pa.array(self.names, pa.binary())

    def bounds(self, top: np.ndarray) -> np.ndarray:
        """Of each item, from the largest share of every term."""
        total = np.concatenate([[0], np.cumsum(self.weights * top[self.term])])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def _lists(column: pa.ListArray, dtype) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _places(column: pa.ListArray, names: pa.Array) -> list[np.ndarray]:
    """The place of each block's terms among names, or -1."""
    at = column.offsets.to_numpy()
    found = pc.fill_null(pc.index_in(column.values, value_set=names), -1).to_numpy(zero_copy_only=False)
    return [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Block:
    """One block as a search sees it: the shares of the items' terms in its documents, made when first asked for."""

    def __init__(self, row: dict[str, np.ndarray], place: np.ndarray, ids: pa.Array, n_names: int):
        self.row, self.place, self.n_names = row, place, n_names
        self.null = np.asarray(ids.is_null())
        self.ids = np.where(self.null, LAST, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))
        self.shares: np.ndarray | None = None

    def scores(self, term: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if self.shares is None:
            here = np.flatnonzero(self.place >= 0)
            column = np.full(len(self.place), -1)
            column[here] = np.arange(len(here))
            self.at = np.full(self.n_names, -1)
            self.at[self.place[here]] = np.arange(len(here))
            doc = np.repeat(np.arange(len(self.ids)), np.diff(self.row["starts"]))
            c = column[self.row["term"]]
            own = c >= 0
            self.shares = np.zeros((len(self.ids), len(here)), np.int64)
            self.shares[doc[own], c[own]] = share(self.row["tf"][own].astype(np.int64), self.row["m"][doc[own]])
        c = self.at[term]
        return self.shares[:, c[c >= 0]] @ weights[c >= 0]


class Best:
    """The k highest (score, id) of an item so far, and the threshold: what a document has to reach."""

    def __init__(self, k: int, score: int = 1, last: int = int(LAST)):
        self.k, self.score, self.last = k, score, last
        self.rows = np.zeros((0, 3), np.int64)

    def below(self, bound: int, low: int) -> bool:
        """No document of a block with this bound and least id can be among the k."""
        return bound < self.score or bound == self.score and low > self.last

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        own = np.flatnonzero((scores > self.score) | (scores == self.score) & (ids <= self.last))
        if len(own):
            rows = np.concatenate([self.rows, np.stack([scores[own], ids[own], null[own].astype(np.int64)], 1)])
            self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]
            if len(self.rows) == self.k:
                self.score, self.last = int(self.rows[-1, 0]), int(self.rows[-1, 1])


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _frequencies(blocks: DataFrame, names: pa.Array) -> dict[int, int]:
    """Documents that hold each term, by its place; a row a term comes to the driver, and terms are those of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for place, dfs in zip(_places(batch.column(0), names), _lists(batch.column(1), np.int64), strict=True):
                own = place >= 0
                total[place[own]] += dfs[own]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "n"])

    counted = blocks.select("terms", "dfs").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


def _bounds(batch: pa.RecordBatch, items: Items, names: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bounds, places): bounds of each item in each block of a batch with the columns terms and tops."""
    places = _places(batch.column("terms"), names)
    bounds = np.zeros((len(items.ids), batch.num_rows), np.int64)
    for b, (place, tops) in enumerate(zip(places, _lists(batch.column("tops"), np.int64), strict=True)):
        top = np.zeros(len(names), np.int64)
        top[place[place >= 0]] = tops[place >= 0]
        bounds[:, b] = items.bounds(top)
    return bounds, places


def _first(blocks: DataFrame, held, first: int) -> DataFrame:
    """(item, block): the blocks with the largest bounds of each item, first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        names = items.terms()
        best = [np.zeros((0, 3), np.int64)] * len(items.ids)
        for batch in batches:
            bounds, _ = _bounds(batch, items, names)
            low, block = (batch.column(c).to_numpy() for c in ("low", "block"))
            for i, own in enumerate(bounds):
                at = np.flatnonzero(own)
                rows = np.concatenate([best[i], np.stack([own[at], low[at], block[at]], 1)])
                best[i] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:first]]
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best])
        rows = np.concatenate([np.zeros((0, 3), np.int64), *best])
        yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(rows[:, c]) for c in range(3))], ["item", "bound", "low", "block"])

    found = blocks.select("block", "low", "terms", "tops").mapInArrow(run, "item int, bound long, low long, block long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "low", "block"))
    return found.withColumn("place", place).where(F.col("place") <= first).select("item", "block")


def scan(batch: pa.RecordBatch, items: Items, names: pa.Array, best: list[Best]) -> int:
    """Each item's blocks of a batch by falling bound, until none can hold a document for best; how many were scored."""
    bounds, places = _bounds(batch, items, names)
    rows = {c: _lists(batch.column(c), np.int64) for c in ("m", "starts", "term", "tf")}
    made = [Block({c: x[b] for c, x in rows.items()}, places[b], batch.column("ids")[b].values, len(names)) for b in range(batch.num_rows)]
    low, scored = batch.column("low").to_numpy(), 0
    for i, own in enumerate(bounds):
        a, z = items.starts[i], items.starts[i + 1]
        for b in np.lexsort((low, -own)).tolist():
            if own[b] < best[i].score:
                break
            if not best[i].below(int(own[b]), int(low[b])):
                best[i].add(made[b].scores(items.term[a:z], items.weights[a:z]), made[b].ids, made[b].null)
                scored += 1
    return scored


def _scored(blocks: DataFrame, held, k: int, least: dict[int, tuple[int, int]]) -> DataFrame:
    """(item, item_id, doc_id, score): for each item the documents of a task that may be among its k best.

    least: an item's (score, id) that k documents are known to reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        names = items.terms()
        best = [Best(k, *least.get(i, ())) for i in range(len(items.ids))]
        for batch in batches:
            scan(batch, items, names, best)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(x.rows) for x in best])
        out = np.concatenate([np.zeros((0, 3), np.int64), *(x.rows for x in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array([items.ids[i] for i in item.tolist()], pa.int64()), pa.array(out[:, 1], mask=out[:, 2] > 0), pa.array(out[:, 0])], ["item", "item_id", "doc_id", "score"],
        )

    columns = ["low", "ids", "m", "terms", "tops", "starts", "term", "tf"]
    return blocks.select(*columns).mapInArrow(run, "item int, item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _search_group(index: Index, items: Items, k: int, first: int) -> DataFrame:
    """Ranked rows of one group of items, as a written table."""
    spark = index.blocks.sparkSession
    items.weigh(_frequencies(index.blocks, items.terms()), index.n_docs)
    held = spark.sparkContext.broadcast(items)
    chosen = _first(index.blocks, held, first).select("block").distinct().collect()  # at most first blocks an item
    seeds = index.blocks.where(F.col("block").isin([r["block"] for r in chosen]))
    least: dict[int, tuple[int, int]] = {}
    for r in _ranked(_scored(seeds, held, k, {}), k).where(F.col("rank") == k).collect():  # one row an item
        least[r["item"]] = r["score"], int(LAST) if r["doc_id"] is None else r["doc_id"]
    return common.written(_scored(index.blocks, held, k, least), "found")


def search(index: Index, items: DataFrame, k: int = 20, first: int = FIRST, item_col: str = "item_id", text_col: str = "text", per_group: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    Equal scores go by rising doc_id, a null id last. Rows of the index are documents, also those that share an id. Rows
    of items with one id are one item with the terms of all its different texts; null texts have none. An item without
    a known term has no row, and an empty table on either side gives none. Other columns are not looked at.
    """
    spark = items.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    if not n or not index.n_docs:
        return spark.createDataFrame([], RESULT)
    groups = max(-(-n // per_group), -(-(size or 0) // ITEM_BYTES))
    found = None
    for g in range(groups):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g) if groups > 1 else asked
        rows = own.groupBy("item_id").agg(F.sort_array(F.collect_list(F.encode("text", "UTF-8"))).alias("texts")).orderBy("item_id").collect()
        group = Items([(r["item_id"], [bytes(t) for t in r["texts"]]) for r in rows])
        if not group.names:
            continue
        with small_batches(spark, BATCH):
            part = _search_group(index, group, k, first)
        part = part.withColumn("item", F.col("item") + F.lit(g).cast("long") * (1 << 32))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], RESULT)
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search() over an index of docs that is deleted afterwards."""
    index = build_index(docs)
    out = search(index, items, k)
    common.dropped(index.blocks)
    return out


ORACLE = rf"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '{TERM}') AS ts FROM documents WHERE text IS NOT NULL),
d AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM words WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY t, nn),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '{TERM}')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY 1, 2),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * nn) // ll) AS m FROM d, a),
s AS (SELECT item_id, r, m.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""
