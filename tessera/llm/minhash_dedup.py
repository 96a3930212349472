"""MinHash near-dedup (6): universal hash minima with banding, signature verification, confirmation on full sets and
connected components by alternating large-star and small-star.

Documents with the same set of shingles are one class, and only its smallest id goes on. A bucket of classes that
share a band is searched in two rounds, neither of which writes out all pairs of a group. In the first, each class is
compared with one other, the smallest class that it shares most buckets with. In the second, classes of a bucket that
the links found so far leave in different components are compared by their signatures, in blocks, and only pairs that
agree are written. The largest component of a bucket isn't compared within itself; so a large group of near copies,
which is one component after the first round, meets only the few that stand apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components

ROWS, BANDS = 6, 44
#: A pair at the limit of 0.8 misses all bands less than twice in a million times.
HASHES = ROWS * BANDS
#: Bytes of a signature that is compared: the low byte of so many minima.
SKETCH = 128
#: Sketches that agree in a smaller share than this aren't of a pair at 0.8 (over five standard deviations).
LEAST_AGREEMENT = 0.6
#: Classes of a bucket that are compared at once.
BLOCK = 512
#: In buckets of more classes than this, the smallest LEAST shingle hashes of each are compared as well.
CROWD = 24
LEAST = 512
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, with A-Z lower-cased, and how many words each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = ~space & np.append(True, space[:-1])[: len(space)]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    letters = np.flatnonzero(~space)
    word = np.cumsum(first)[letters] - 1
    place = letters - starts[word]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _PRIME, np.uint64))
        value = (_LOWER[data[letters]].astype(np.uint64) + np.uint64(1)) * powers[place]
        hashes = common.mix64(np.add.reduceat(value, np.flatnonzero(place == 0)))
    return hashes, np.diff(np.append(0, np.searchsorted(starts, ends)))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text with fewer words has its whole sequence as one."""
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for n in counts.tolist():
            h, at = hashes[at : at + n], at + n
            if n == 0:
                out.append(np.zeros(0, np.uint64))
                continue
            k = min(words, n)
            s = h[: n - k + 1].copy()
            for j in range(1, k):
                s = common.mix64(s * _PRIME + h[j : n - k + 1 + j])
            out.append(np.unique(common.mix64(s + np.uint64(k))))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over a set that isn't empty."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            low = np.minimum(low, (_A[:, None] * shingles[None, at : at + 512] + _B[:, None]).min(1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
    for a, b in common.blocks_of([len(t) for t in texts], 1 << 20):
        yield a, b, texts[a:b]


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _groups(batch):
                sets = shingle_sets(texts, words)
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signs = [signature(s) if len(s) else None for s in sets]
                bands = [_keys(x).tobytes() if x is not None else None for x in signs]
                sketch = [x[:SKETCH].astype(np.uint8).tobytes() if x is not None else None for x in signs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.binary()), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return run


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, low): the upper halves of the smallest LEAST hashes of each set."""
    for batch in batches:
        lows = [(np.frombuffer(m, np.uint64)[:LEAST] >> np.uint64(32)).astype(np.uint32).tobytes() for m in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lows, pa.binary())], ["id", "low"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _groups(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(texts, words)], pa.binary())], ["id", "members"])

    return run


def _keys(sign: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's rows."""
    key = np.arange(BANDS, dtype=np.uint64)
    rows = sign.reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = common.mix64(key * _PRIME + rows[:, r])
    return key


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, id) rows of (id, bands)."""
    for batch in batches:
        if batch.num_rows:
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (u, v, sketch, sketch) the pairs whose sketches agree well enough."""
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array((_sketches(batch.column(2)) == _sketches(batch.column(3))).mean(1) >= LEAST_AGREEMENT)).select([0, 1])


def _common(lows: list[bytes], a: int, b: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of the least hashes rows i and j have in common; all of them lie in the rows a to b, where many do."""
    size = np.array([len(x) // 4 for x in lows[a:b]])
    column, flat = np.unique(np.frombuffer(b"".join(lows[a:b]), np.uint32), return_inverse=True)
    row = np.repeat(np.arange(b - a), size)
    often = np.bincount(flat, minlength=len(column)) > 1
    new = np.cumsum(often) - 1
    row, flat = row[often[flat]], new[flat[often[flat]]]
    total = np.zeros((b - a, b - a), np.float32)
    for at in range(0, int(often.sum()), 4096):
        some = (flat >= at) & (flat < at + 4096)
        x = np.zeros((b - a, 4096), np.float32)
        x[row[some], flat[some] - at] = 1
        total += x @ x.T
    return total[i - a, j - a]


def _may_link(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements can link that have so many of their least hashes in common: for certain where
    both sets are of LEAST at most, else but for six standard deviations."""
    need = percent * (n + m) / (100 + percent)
    share = LEAST * need / np.maximum(n, m)
    return np.where(np.maximum(n, m) <= LEAST, both >= need - 1e-6, both >= share - 6 * np.sqrt(LEAST) / 2)


def _in_blocks(percent: int):
    """(key, unit, left, id, part, n, sketch, low), sorted by key and unit, to pairs (u, v) of a unit, u > v, that lie
    in different parts and agree by size, sketch and, where they are given, the least hashes. Rows of one side aren't
    compared, unless they have no side."""

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        key, unit, ids, part, n = (t.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
        left = t.column(2).combine_chunks().to_numpy(zero_copy_only=False)
        sketch = _sketches(t.column(6).combine_chunks())
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])))
        size = np.diff(np.append(start, len(key)))
        first, end = np.repeat(start, size), np.repeat(np.append(start[1:], len(key)), size)
        low = t.column(7).to_pylist()
        after = end - np.arange(len(key)) - 1
        out = []
        for a, b in common.blocks_of(after.tolist(), 400_000):
            i = np.repeat(np.arange(a, b), after[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[a:b]) - after[a:b], after[a:b])
            sided = np.array([x is not None for x in left[i]], bool) if left.dtype == object else np.ones(len(i), bool)
            ok = (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((left[i] != left[j]) | ~sided)
            i, j = i[ok], j[ok]
            ok = (sketch[i] == sketch[j]).mean(1) >= LEAST_AGREEMENT if len(i) else np.zeros(0, bool)
            i, j = i[ok], j[ok]
            ok = np.ones(len(i), bool)
            for x in np.unique(first[i]):  # crowded units, one after another
                if low[x]:
                    mine = first[i] == x
                    ok[mine] = _may_link(_common(low, x, end[x], i[mine], j[mine]), n[i[mine]], n[j[mine]], percent)
            out.append(np.stack([np.maximum(ids[i[ok]], ids[j[ok]]), np.minimum(ids[i[ok]], ids[j[ok]])], 1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last unit of a batch are complete
            key, unit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            last = held[-1] if held else None
            if cut == 0 and last is not None and (last.column(0)[-1].as_py(), last.column(1)[-1].as_py()) != (key[-1], unit[-1]):
                yield pairs(held)
                held = []
            elif cut:
                yield pairs([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pairs(held)

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those that are links on their full sets."""
    near = pairs.join(sets.select(F.col("id").alias("u"), F.col("members").alias("mu")).hint("merge"), "u")
    near = near.join(sets.select(F.col("id").alias("v"), F.col("members").alias("mv")).hint("merge"), "v")
    return near.select("u", "v", "mu", "mv").mapInArrow(common.trimmed(_confirmed(percent)), "u long, v long")


def _apart(placed: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of a bucket's classes in different parts that agree by size and sketch. placed: (key, id, part)."""
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    rest = common.written(placed.join(mixed.hint("merge"), "key", "left_semi"), "mixed")
    parts = rest.groupBy("key", "part").agg(F.count("*").alias("n"))
    info = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"))
    info = info.select("key", "main", "n_all", F.ceil(F.col("n_main") / BLOCK).alias("b_main"), F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).alias("b_rest"))
    rows = rest.join(info.hint("merge"), "key")
    is_main = F.col("part") == F.col("main")
    mine = F.when(is_main, F.pmod(F.xxhash64("id"), "b_main")).otherwise(F.col("b_main") + F.pmod(F.xxhash64("id"), "b_rest"))
    others = F.sequence(F.when(is_main, F.col("b_main")).otherwise(F.lit(0)), F.col("b_main") + F.col("b_rest") - 1)
    none = F.lit(None).cast("boolean")
    pick = lambda o: F.struct((F.least(o, F.col("mine")) * (1 << 24) + F.greatest(o, F.col("mine")) + 1).alias("unit"), F.when(o != F.col("mine"), o > F.col("mine")).alias("left"))
    units = F.when(F.col("n_all") <= BLOCK, F.array(F.struct(F.lit(0).cast("long").alias("unit"), none.alias("left")))).otherwise(F.transform("others", pick))
    rows = rows.select("key", "id", "part", "n_all", (F.col("n_all") > CROWD).alias("crowded"), mine.cast("long").alias("mine"), others.alias("others")).select("key", "id", "part", "crowded", F.inline(units))
    rows = common.written(rows, "units")
    in_crowd = common.written(rows.where("crowded").select("id").distinct(), "crowds")
    low = sets.join(in_crowd.hint("merge"), "id", "left_semi").mapInArrow(common.trimmed(_least), "id long, low binary")
    signs = common.written(signs.join(low.hint("merge"), "id", "left"), "signs")
    rows = rows.join(signs.hint("merge"), "id").select("key", "unit", "left", "id", "part", "n", "sketch", F.when(F.col("crowded"), F.col("low")).otherwise(F.lit(b"")).alias("low"))
    rows = rows.repartition("key", "unit").sortWithinPartitions("key", "unit")
    return rows.mapInArrow(common.trimmed(_in_blocks(percent)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links are pairs of documents with 100 * intersection >= percent * union of their distinct shingles of so many
    words; component_id is the smallest doc_id reachable by links. A text with fewer words has its whole sequence as
    its one shingle; null texts and texts without words have no shingle and link with nothing. Rows that repeat an id
    are one document for links, so a link of either counts, and each gives a row. Rows with a null id link with
    nothing: their component_id is null and they are kept. An empty table gives no rows; other columns aren't looked at.
    """
    before = common.held()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = common.written(rows.mapInArrow(common.trimmed(_signed(words)), "doc_id long, n_shingles long, digest binary, bands binary, sketch binary"), "signatures")
    live = signed.where("doc_id is not null and digest is not null")
    classes = common.written(live.groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    signs = classes.select("id", "n", "sketch")
    banded = classes.select("id", "bands").mapInArrow(common.trimmed(_banded), "key long, id long")
    shared = banded.groupBy("key").agg(F.count("*").alias("in_key")).where("in_key > 1").select("key")
    buckets = common.written(banded.join(shared.hint("merge"), "key", "left_semi"), "buckets")
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = rows.join(wanted, "doc_id", "left_semi").mapInArrow(common.trimmed(_sets(words)), "id long, members binary")
    sets = common.written(sets, "sets")
    common.released(sets.sparkSession)
    # first round: one comparison for each class, with the head that it shares most buckets with; the head of a bucket
    # is the class with most companions over all its buckets, which in a group of edited copies is their original
    sized = buckets.groupBy("key").agg(F.count("*").alias("size"))
    degree = buckets.join(common.written(sized, "sizes").hint("merge"), "key").groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = buckets.join(common.written(degree, "degrees").hint("merge"), "id").select("key", "id", F.struct("degree", -F.col("id")).alias("place"))
    heads = common.written(ranked.groupBy("key").agg(F.max("place").alias("top")).select("key", (-F.col("top.col2")).alias("head"), "top"), "heads")
    heads = ranked.join(heads.hint("merge"), "key").where("place < top").groupBy("id", "head").agg(F.count("*").alias("n"), F.max("top").alias("top"))
    first = heads.groupBy("id").agg(F.max_by("head", F.struct("n", "top")).alias("v")).select(F.col("id").alias("u"), "v")
    u, v = (signs.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "uv")
    first = first.join(u.hint("merge"), "u").join(v.hint("merge"), "v").where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    first = common.written(first.select("u", "v", "su", "sv").mapInArrow(common.trimmed(_agreeing), "u long, v long"), "pairs")
    links = common.written(_linked(first, sets, percent), "links")
    # second round: what the first leaves in different components of a bucket
    parts = components(links).withColumnRenamed("node", "id")
    placed = common.written(buckets.join(parts.hint("merge"), "id", "left").select("key", "id", F.coalesce("component_id", "id").alias("part")), "placed")
    common.dropped(buckets)
    common.released(sets.sparkSession)
    pairs = _apart(placed, signs, sets, percent).join(first.hint("merge"), ["u", "v"], "left_anti")
    more = common.written(_linked(pairs, sets, percent), "links")
    common.dropped(placed)
    common.dropped(sets)
    member = live.select("doc_id", "digest").join(classes.select("digest", "id").hint("merge"), "digest").select("doc_id", "id")
    twice = member.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    same = twice.select(F.col("high").alias("u"), F.col("low").alias("v"))  # an id of two rows holds their classes together
    of_class = components(links.unionByName(more).unionByName(same)).withColumnRenamed("node", "id")
    member = member.join(of_class, "id", "left").select("doc_id", F.coalesce("component_id", "id").alias("component_id"))
    own = member.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(own.hint("merge"), "doc_id", "left")
    place = F.coalesce("component_id", "doc_id")
    return common.swept(out.select("doc_id", "n_shingles", place.alias("component_id"), F.coalesce(F.col("doc_id") == place, F.lit(True)).alias("kept")), before)
