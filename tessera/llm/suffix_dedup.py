"""Suffix-array dedup (7): repeated windows of tokens by a depth-limited most-significant-digit radix sort.

The suffixes to order are the starts of all windows of ``span`` tokens, and only their first span tokens count. A token
is a byte (windows of 400) or a word (windows of 51). Passes go from a coarse digit to the whole window;
what is alone in its bucket after a pass is in no repeated window and leaves.

* Digit 0 is a window's anchor: the leftmost smallest hash among its pieces of ``piece`` tokens. Windows with equal
  tokens have equal anchors at equal places, so a window whose anchor stands nowhere else is alone. Neighbouring windows
  share their anchor, so the pass moves a row for each anchor, about one for every 170 bytes or 22 words.
* Digit 1 divides the windows of an anchor into ranges of ``step`` starts; the digit is what all windows of a range share.
* Digit 2 is the window itself.

In every pass rows whose whole tokens occur twice are done, all windows in them being repeated; one of each distinct
rest goes on if its bucket holds another. Buckets exist as keys of sums with map-side partial sums, and rows return to
them by sort-merge semi joins with tables of these keys, which AQE can divide; so no bucket has to fit in a task,
however many documents share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.minhash_dedup import word_hashes

SPAN = 400
PIECE = 64
STEP = 32
#: Passages of over 50 words.
WORD_SPAN = 51
#: Tokens that are hashed at once; longer texts go in chunks that overlap.
CHUNK = 1 << 20
#: Window starts whose ranges are merged together.
REGION = 1 << 13
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: doc_id and the hash of the text: which text a row is of. lo, hi: first and last window start; at: the anchor; unit:
#: the place in the list of units. The bucket depends on the unit, so all units share the passes.
ROW = "bucket long, digit long, whole long, doc_id long, text_hash long, lo long, hi long, at long, unit int"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def byte_tokens(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts]


def word_tokens(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text: runs without white space, with A-Z lower-cased."""
    out: list[np.ndarray] = []
    for a, b in common.blocks_of([len(t) for t in texts], CHUNK):
        hashes, counts = word_hashes(texts[a:b])
        out += np.split(hashes, np.cumsum(counts)[:-1])
    return out


@dataclass(frozen=True)
class Unit:
    """What a window is made of: its tokens and their number, those of an anchor, and the starts of a range."""

    tokens: Callable[[list[bytes]], list[np.ndarray]]
    kind: str
    span: int
    piece: int
    step: int

    def __post_init__(self) -> None:
        if self.span < 2 * self.piece:
            raise ValueError(f"a window has to have {2 * self.piece} tokens or more")




@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(_U(1), np.full(n, _PRIME, _U))), np.cumprod(np.append(_U(1), np.full(n, _INVERSE, _U)))


class Hashed:
    """Polynomial hashes of any part of a block of tokens."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(12, int(len(data)).bit_length())
        up, self.down = _powers(n)
        with np.errstate(over="ignore"):
            self.sums = np.append(_U(0), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)]))

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return common.mix64((self.sums[end] - self.sums[start]) * self.down[start])


def _mixed(h: np.ndarray, *more: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for m in more:
            h = common.mix64(h * _PRIME + np.asarray(m).astype(np.int64).view(_U))
    return h


def anchors(data: np.ndarray, valid: np.ndarray, span: int, piece: int) -> tuple[np.ndarray, ...]:
    """For a block of tokens and a mask of its window starts: anchor places, their first and last window starts, the
    hash of the anchor and the hash of all tokens that its windows cover."""
    width = span - piece + 1
    hashed = Hashed(data)
    n = len(data) - piece + 1
    place = np.arange(max(n, 0))
    low = (hashed.part(place, place + piece) & ~_U((1 << 24) - 1)) | place.astype(_U)
    got = 1
    while got * 2 <= width:
        low = np.minimum(low[: len(low) - got], low[got:])
        got *= 2
    if got < width:
        low = np.minimum(low[: len(low) - (width - got)], low[width - got :])
    starts = np.flatnonzero(valid[: len(low)])
    at = (low[starts] & _U((1 << 24) - 1)).astype(np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)))
    last = np.append(first[1:], len(at)) - 1
    a, lo, hi = at[first], starts[first], starts[last]
    return a, lo, hi, hashed.part(a, a + piece), _mixed(hashed.part(lo, hi + span), a - lo, hi - lo)


def chunks(texts: list[np.ndarray], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts, or of one long text in parts: tokens, valid window starts, owner and offset by token."""
    long = [i for i, t in enumerate(texts) if len(t) > CHUNK]
    short = [i for i, t in enumerate(texts) if span <= len(t) <= CHUNK]
    for a, b in common.blocks_of([len(texts[i]) for i in short], CHUNK):
        some = short[a:b]
        size = np.array([len(texts[i]) for i in some])
        data = np.concatenate([texts[i] for i in some])
        offset = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        yield data, offset <= np.repeat(size, size) - span, np.repeat(some, size), offset
    for i in long:
        for start in range(0, len(texts[i]) - span + 1, CHUNK):
            data = texts[i][start : start + CHUNK + span - 1]
            place = np.arange(len(data))
            yield data, (place < CHUNK) & (place <= len(data) - span), np.full(len(data), i), place + start


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != _U else x.view(np.int64))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _rows(batch: pa.RecordBatch, ids: int, take: np.ndarray, unit: int, bucket: pa.Array, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of ROW: doc_id and text_hash are the columns at ids of the batch, taken at the given rows."""
    digit, whole, *places = map(_signed, columns)
    at = pa.array(take)
    return pa.RecordBatch.from_arrays([bucket, digit, whole, batch.column(ids).take(at), batch.column(ids + 1).take(at), *places, pa.array(np.full(len(take), unit, np.int32))], NAMES)


def _digit0(units: list[Unit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(2))
            for k, unit in enumerate(units):
                for data, valid, owner, offset in chunks(unit.tokens(texts), unit.span):
                    a, lo, hi, own, whole = anchors(data, valid, unit.span, unit.piece)
                    if len(a):
                        shift = offset[a] - a
                        yield _rows(batch, 0, owner[a], k, _signed(_mixed(own, np.full(len(a), k))), np.zeros(len(a), np.int64), whole, lo + shift, hi + shift, a + shift)

    return run


def _cut(units: list[Unit]):
    """The tokens that the windows of each wanted anchor cover, out of (doc_id, text_hash, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(2))
            for k, unit in enumerate(units):
                out: list[tuple] = []
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unit.tokens(texts), batch.column(3).to_pylist(), strict=True)
                for doc_id, text_hash, tokens, wanted in rows:
                    for w in wanted:
                        if w["unit"] == k:
                            out.append((w["bucket"], doc_id, text_hash, w["lo"], w["hi"], w["at"], tokens[w["lo"] : w["hi"] + unit.span].tobytes(), k))
                    if len(out) > 4000:
                        yield _context_batch(out)
                        out = []
                if out:
                    yield _context_batch(out)

    return run


CONTEXT = "bucket long, doc_id long, text_hash long, lo long, hi long, at long, tokens binary, unit int"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary()), pa.array(columns[7], pa.int32())], [x.split()[0] for x in CONTEXT.split(", ")])


def _contexts(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, int, Hashed, np.ndarray, np.ndarray]]:
    """Contexts in blocks: index range, hashes of the joined tokens, where each context begins, and its row in the block."""
    parts = batch.column(6).to_pylist()
    width = np.dtype(kind).itemsize
    for a, b in common.blocks_of([len(p) // width for p in parts], CHUNK):
        size = np.array([len(p) // width for p in parts[a:b]])
        yield a, b, Hashed(np.frombuffer(b"".join(parts[a:b]), kind)), np.cumsum(size) - size, np.arange(a, b)


def _of_unit(batches: Iterator[pa.RecordBatch], units: list[Unit]) -> Iterator[tuple[pa.RecordBatch, int, Unit]]:
    for batch in batches:
        mine = batch.column(7).to_numpy()
        for k, unit in enumerate(units):
            some = batch.filter(pa.array(mine == k))
            if some.num_rows:
                yield some, k, unit


def _digit1(units: list[Unit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, unit in _of_unit(batches, units):
            span, piece, step = unit.span, unit.piece, unit.step
            for a, b, hashed, base, row in _contexts(batch, unit.kind):
                lo, hi, at = (batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
                back = span - piece  # the earliest window of an anchor starts so far before it
                first, last = (lo - at + back) // step, (hi - at + back) // step
                n = last - first + 1
                i = np.repeat(np.arange(b - a), n)
                node = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start, end = at[i] - back + node * step, at[i] - back + np.minimum((node + 1) * step - 1, back)
                zero = base[i] - lo[i]
                shared = hashed.part(zero + np.minimum(end, at[i]), zero + np.maximum(start + span, at[i] + piece))
                from_, to = np.maximum(start, lo[i]), np.minimum(end, hi[i])
                whole = _mixed(hashed.part(zero + from_, zero + to + span), node, from_ - start, to - from_)
                yield _rows(batch, 1, row[i], k, batch.column(0).take(pa.array(row[i])), _mixed(shared, node), whole, from_, to, at[i])

    return run


def _digit2(units: list[Unit]):
    """The windows of the ranges (lo, hi) that are left, out of contexts joined with a list of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, unit in _of_unit(batches, units):
            wanted = batch.column(8).to_pylist()
            for a, b, hashed, base, row in _contexts(batch, unit.kind):
                lo, at = (batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
                i = np.repeat(np.arange(b - a), [sum(w["hi"] - w["lo"] + 1 for w in ws) for ws in wanted[a:b]])
                p = np.concatenate([np.arange(w["lo"], w["hi"] + 1) for ws in wanted[a:b] for w in ws])
                zero = base[i] - lo[i]
                whole = _mixed(hashed.part(zero + p, zero + p + unit.span), at[i] - p)
                yield _rows(batch, 1, row[i], k, batch.column(0).take(pa.array(row[i])), whole, whole, p, p, at[i])

    return run


def _pass(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One radix pass: (rows that repeat as a whole, one of each distinct rest in a bucket with others).

    The keys that rows are joined with are tables, not sums of the same shuffle, so AQE can divide a busy bucket.
    """
    rows = common.written(rows, name)
    busy = common.written(rows.groupBy("bucket", "digit").agg(F.count("*").alias("n")).where("n > 1").select("bucket", "digit"), name)
    live = common.written(rows.join(busy.hint("merge"), ["bucket", "digit"], "left_semi"), name)
    common.dropped(rows, busy)
    common.released(live.sparkSession)
    first = [F.first(c).alias(c) for c in NAMES[3:]]
    groups = common.written(live.groupBy("bucket", "digit", "whole").agg(F.count("*").alias("n"), *first), name)
    many = groups.where("n > 1").select("bucket", "digit", "whole")
    repeated = common.written(live.join(many.hint("merge"), ["bucket", "digit", "whole"], "left_semi").select("doc_id", "text_hash", "lo", "hi", "unit"), name)
    common.dropped(live)
    several = common.written(groups.groupBy("bucket", "digit").agg(F.count("*").alias("k")).where("k > 1").select("bucket", "digit"), name)
    rest = common.written(groups.join(several.hint("merge"), ["bucket", "digit"], "left_semi").select(*NAMES), name)
    common.dropped(groups, several)
    common.released(rest.sparkSession)
    return repeated, rest


def repeated_windows(texts: DataFrame, units: list[Unit]) -> DataFrame:
    """(doc_id, text_hash, lo, hi, unit): ranges of window starts whose windows also start elsewhere, as a written table.

    texts: (doc_id, text_hash, text); equal rows are texts of their own.
    """
    whole, rest = _pass(texts.mapInArrow(_digit0(units), ROW), "digit0")
    wanted = rest.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("bucket", "lo", "hi", "at", "unit")).alias("wanted"))
    # an equal text repeats as a whole, and one row of it is enough
    mine = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_hash") == F.col("w.text_hash"))
    held = texts.alias("t").join(wanted.hint("merge").alias("w"), mine).select("t.doc_id", "t.text_hash", "t.text", "w.wanted")
    contexts = common.written(held.mapInArrow(_cut(units), CONTEXT), "contexts")
    common.dropped(rest)
    common.released(contexts.sparkSession)
    ranges, rest = _pass(contexts.mapInArrow(_digit1(units), ROW), "digit1")
    left = rest.groupBy("doc_id", "text_hash", "unit", "at").agg(F.collect_list(F.struct("lo", "hi")).alias("left"))
    mine = F.col("c.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("c.text_hash") == F.col("w.text_hash")) & (F.col("c.at") == F.col("w.at")) & (F.col("c.unit") == F.col("w.unit"))
    # an anchor at the boundary of two chunks has a context in each, and a range is in the one that covers it
    inside = F.filter("w.left", lambda r: (r["lo"] >= F.col("c.lo")) & (r["hi"] <= F.col("c.hi")))
    held = contexts.alias("c").join(left.hint("merge").alias("w"), mine).select("c.*", inside.alias("left")).where(F.size("left") > 0)
    windows, last = _pass(held.mapInArrow(_digit2(units), ROW), "digit2")
    common.dropped(contexts, rest, last)
    found = whole.unionByName(ranges).unionByName(windows)
    by_region = found.groupBy("doc_id", "text_hash", "unit", F.floor(F.col("lo") / REGION).alias("region")).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    merged = by_region.select("doc_id", "text_hash", "ranges", "unit").mapInArrow(_merged, "doc_id long, text_hash long, lo long, hi long, unit int")
    merged = common.written(merged, "ranges")
    common.dropped(whole, ranges, windows)
    common.released(merged.sparkSession)
    return merged


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text_hash, ranges) a row for each run of ranges without a gap."""
    for batch in batches:
        row, lo, hi = [], [], []
        for k, ranges in enumerate(batch.column(2).to_pylist()):
            for a, b in sorted((r["lo"], r["hi"]) for r in ranges):
                if row and row[-1] == k and a <= hi[-1] + 1:
                    hi[-1] = max(hi[-1], b)
                else:
                    row.append(k), lo.append(a), hi.append(b)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), batch.column(3).take(take)], ["doc_id", "text_hash", "lo", "hi", "unit"])


def _covered(n: int, ranges: list[dict] | None, span: int) -> np.ndarray:
    """Which of n tokens lie in a window of the ranges."""
    step = np.zeros(n + 1, np.int64)
    if ranges:
        np.add.at(step, [r["lo"] for r in ranges], 1)
        np.add.at(step, [r["hi"] + span for r in ranges], -1)
    return np.cumsum(step)[:-1] > 0


def _removed(span: int, word_span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges, words in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                gone = _covered(len(data), ranges, span)
                runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
                shared = int(_covered(max(r["hi"] for r in words) + word_span, words, word_span).sum()) if words else 0
                out.append((len(data), int(gone.sum()), runs, shared, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            n, g, r, w, h = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, g, r)], pa.array(h, pa.string()), pa.array(w, pa.int64())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"])

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, word_span: int | None = WORD_SPAN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words.

    Removes every byte that is covered by a string of span bytes which also starts anywhere else, in the same document
    or another; all copies go. n_shared_words counts the words that lie in a passage of word_span words which also
    stands elsewhere, whatever its bytes: passages of many short words are under span bytes, stay in the text and are
    told here; without word_span it is 0. Null counts as the empty text. Rows that repeat an id, or have none, are
    documents of their own; an empty table gives no rows; other columns aren't looked at. Windows are compared by two
    independent 64-bit hashes, of their anchor and of all their tokens.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    units = [Unit(byte_tokens, "u1", span, PIECE, STEP)]
    if word_span is not None:
        units.append(Unit(word_tokens, "<u8", word_span, min(8, word_span // 2), 8))
    of = lambda unit, name: F.collect_list(F.when(F.col("unit") == unit, F.struct("lo", "hi"))).alias(name)
    found = repeated_windows(texts, units).groupBy("doc_id", "text_hash").agg(of(0, "ranges"), of(1, "words"))
    mine = F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.text_hash") == F.col("r.text_hash"))
    held = texts.alias("t").join(found.hint("merge").alias("r"), mine, "left").select("t.doc_id", "t.text", "r.ranges", "r.words")
    return held.mapInArrow(_removed(span, word_span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")
