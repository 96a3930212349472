"""SentencePiece encoding and decoding (5): vectorised merge rounds over flat symbol arrays.

The distinct words of a batch lie one after another in a flat array of piece ids. In each round every word finds the
best-ranked adjacent pair (a segmented minimum), all its occurrences merge from the left at once, and the array is
compacted; words without a pair left drop out. A pair whose merged piece can open a pair of an equal or better rank
merges from the left, each place with all that it opens before the next one, which is what a priority queue would do: in
a short word only its leftmost place in a round, in a word with many such places all of them in one sweep, whose steps
look at the two neighbours of the growing piece only. What is left of a very long word, once a round would merge next to
nothing of it, goes to a priority queue. So time grows with the length of a word, not with its square.

Only the model file is read; the library itself isn't needed. A batch of texts costs memory in proportion to its own
size, and the cache of known words is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

MARK = "▁"
CACHED_WORDS = 400_000
#: Characters of words that are merged together in one flat array.
FLAT = 100_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = np.int64(2**62)
#: A word with more places than this for a pair that merges from the left is swept.
SWEEP = 4
#: A word of more symbols than this goes to a queue when a round merges less than one in THIN of them.
LONG, THIN = 4096, 200


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, ranks and the derived tables of a BPE model with byte fallback.

    Supported: identity normalisation with escaped white space, with or without a dummy prefix; models that need
    another normalisation are refused.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds = [], []
        spec: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                kinds.append(piece.get(3, 1))
            elif number == 3:
                spec = dict(_fields(value))
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1) or set(kinds) - {1, 2, 3, 6}:
            raise ValueError("only identity normalisation without removal of white space is supported")
        self.prefix = bool(spec.get(3, 1))
        n = len(self.pieces)
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        self.char_ids = {p: i for p, i in ids.items() if len(p) == 1}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = np.full(n, NONE)
        for i in ids.values():
            rank[i] = order[scores[i]]
        pairs, inside, best_beside = {}, set(), np.full(n, NONE)
        for p, i in ids.items():
            for k in range(1, len(p)):
                inside.add((p[k - 1], p[k]))
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
                    for part in (left, right):
                        best_beside[part] = min(best_beside[part], rank[i])
        self.size = n
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.pair_ranks = rank[self.pair_ids]
        self.pair_of = dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_ids.tolist(), strict=True), strict=True))
        self.alone = best_beside <= rank  # merging such a piece can open a pair that comes before its other occurrences
        self.cuts_blank = not any(b == MARK and a != MARK for a, b in inside)
        self.cuts_line = not any("\n" in x for x in inside)
        code = sorted({ord(c) for c in self.char_ids} | {ord(x) for ab in inside for x in ab})
        self.codes = np.array(code, np.uint32)
        self.code_ids = np.array([self.char_ids.get(chr(c), -1) for c in code], np.int64)
        self.inside = np.array(sorted((ord(a) << 21) | ord(b) for a, b in inside), np.int64)
        self.chops, self.run = False, max((k for k in range(1, 64) if MARK * k in ids), default=1)
        raw = [bytes([int(p[3:5], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else (" ⁇ " if kinds[i] == 2 else p.replace(MARK, " ")).encode() for i, p in enumerate(self.pieces)]
        self.raw_length = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        blank = r"▁"
        self.split = re.compile(rf"{blank}+[^{blank}\n]*|[^{blank}\n]+|\n" if self.cuts_blank and self.cuts_line else r"(?s:.+)")
        # long runs of blanks: cut in pieces of the longest run where merging is seen to fill these from the left, and
        # only after all pairs with other characters
        blanks = [scores[ids[MARK * k]] for k in range(2, self.run + 1) if MARK * k in ids]
        if self.run > 2 and max(blanks) < min(scores[i] for p, i in ids.items() if p.strip(MARK)):
            got = self.encode_words([MARK * k for k in range(1, 5 * self.run)])
            whole = ids[MARK * self.run]
            self.chops = all(g[0] == whole and np.array_equal(g[1:], got[k - self.run]) for k, g in enumerate(got) if k >= self.run)

    def escaped(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def words(self, escaped: str) -> list[str]:
        """Parts of a text that no piece crosses."""
        found = self.split.findall(escaped)
        if not self.chops or MARK * (2 * self.run + 1) not in escaped:
            return found
        out: list[str] = []
        for w in found:
            blanks = len(w) - len(w.lstrip(MARK))
            while blanks > 2 * self.run:
                out.append(MARK * self.run)
                w, blanks = w[self.run :], blanks - self.run
            out.append(w)
        return out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        flat, bounds = self.encode_flat(words)
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and the bounds of each word; no word is empty."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = np.minimum(np.searchsorted(self.codes, chars), len(self.codes) - 1)
        known = self.codes[at] == chars
        symbols = np.where(known, self.code_ids[at], -1)
        word = np.repeat(np.arange(len(words)), lengths)
        # segments: a word is cut where no piece holds both characters
        joined = np.zeros(len(chars), bool)
        if len(chars) > 1:
            key = (chars[:-1].astype(np.int64) << 21) | chars[1:]
            spot = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
            joined[1:] = (self.inside[spot] == key) & (word[1:] == word[:-1])
        segment = np.cumsum(~joined) - 1
        origin = np.arange(len(chars))
        symbols, origin = self._merge(symbols, segment, origin)
        # unknown characters become their UTF-8 bytes
        missing = np.flatnonzero(symbols < 0)
        if len(missing):
            expanded = [self.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in chars[origin[missing]]]
            repeat = np.ones(len(symbols), np.int64)
            repeat[missing] = [len(x) for x in expanded]
            place = np.repeat(symbols < 0, repeat)
            symbols, origin = np.repeat(symbols, repeat), np.repeat(origin, repeat)
            symbols[place] = np.concatenate(expanded)
        return symbols.astype(np.int32), np.append(0, np.cumsum(np.bincount(word[origin], minlength=len(words))))

    def _ranked(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where(same & (left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NONE), np.where(hit, self.pair_ids[at], -1)

    def _merge(self, symbols: np.ndarray, segment: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds until no pair remains; symbols in their first order, with the place of their first character."""
        done_s, done_o = [], []
        ranks = pieces = None
        while len(symbols):
            if ranks is None:
                same = np.append(segment[1:] == segment[:-1], False)
                ranks, pieces = self._ranked(symbols, np.append(symbols[1:], -1), same)
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            lowest = np.minimum.reduceat(ranks, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(lowest < NONE, size)
            if not live.all():
                done_s.append(symbols[~live])
                done_o.append(origin[~live])
                symbols, segment, origin, ranks, pieces = (x[live] for x in (symbols, segment, origin, ranks, pieces))
                if not len(symbols):
                    break
                size, lowest = size[lowest < NONE], lowest[lowest < NONE]
                first = np.append(0, np.cumsum(size)[:-1])
            chosen = np.flatnonzero(ranks == np.repeat(lowest, size))
            if size.max() > LONG:
                word = np.searchsorted(first, chosen, "right") - 1
                thin = (size > LONG) & (np.bincount(word, minlength=len(size)) * THIN < size)
                if thin.any():
                    for k in np.flatnonzero(thin):
                        a, b = int(first[k]), int(first[k] + size[k])
                        found, place = self._queued(symbols[a:b], ranks[a:b], pieces[a:b])
                        done_s.append(found)
                        done_o.append(origin[a:b][place])
                    rest = np.repeat(~thin, size)
                    symbols, segment, origin, ranks, pieces = (x[rest] for x in (symbols, segment, origin, ranks, pieces))
                    continue
            # of occurrences that overlap, every second one from the left; lone pieces only at their first place
            seg = segment[chosen]
            new_run = np.append(True, (np.diff(chosen) != 1) | (seg[1:] != seg[:-1]))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
            keep = (np.arange(len(chosen)) - run_start) % 2 == 0
            leads = np.append(True, seg[1:] != seg[:-1])
            # a tie between different pieces takes the leftmost alone as well
            lead_piece = pieces[chosen][np.maximum.accumulate(np.where(leads, np.arange(len(chosen)), 0))]
            mixed = np.zeros(len(size), bool)
            order = np.cumsum(leads) - 1
            odd = (pieces[chosen] != lead_piece) | self.alone[pieces[chosen]]
            mixed[: order[-1] + 1] = np.bincount(order, odd, order[-1] + 1) > 0
            stay = np.ones(len(symbols), bool)
            touched = np.zeros(len(symbols), bool)
            many = np.bincount(order) > SWEEP
            swept = (mixed[: len(many)] & many)[order]
            for group in np.flatnonzero(mixed[: len(many)] & many):
                places = chosen[order == group] if len(many) > 1 else chosen
                a = first[np.searchsorted(first, places[0], "right") - 1]
                self._sweep(symbols, stay, touched, int(a), int(a + size[np.searchsorted(first, a)]), places.tolist(), int(ranks[places[0]]))
            chosen = chosen[keep & (leads | ~mixed[order]) & ~swept]
            symbols[chosen] = pieces[chosen]
            stay[chosen + 1] = False
            touched[chosen] = True
            symbols, segment, origin, ranks, pieces, touched = (x[stay] for x in (symbols, segment, origin, ranks, pieces, touched))
            fresh = np.flatnonzero(touched | np.append(touched[1:], False))
            after = np.minimum(fresh + 1, len(symbols) - 1)
            same = (after > fresh) & (segment[after] == segment[fresh])
            ranks[fresh], pieces[fresh] = self._ranked(symbols[fresh], symbols[after], same)
        s, o = np.concatenate([*done_s, symbols]), np.concatenate([*done_o, origin])
        order = np.argsort(o, kind="stable")
        return s[order], o[order]

    def _sweep(self, symbols: np.ndarray, stay: np.ndarray, touched: np.ndarray, a: int, b: int, places: list[int], rank: int) -> None:
        """Merges all pairs of a word, the symbols a to b, that are of the given rank and all better ones that these open,
        from the left. places: where the pairs of that rank are, the best in the word."""
        pair_of, n = self.pair_of.get, self.size
        sym = symbols[a:b].tolist()
        end = b - a
        # the symbols left of the growing piece that are still there, and the first one to the right of it
        kept: list[int] = []
        at, nothing = 0, (NONE, -1)
        heads: list[int] = []
        for place in places:
            p = place - a
            if p < at:
                continue  # its left symbol is part of a piece by now
            kept.extend(range(at, p))
            right = p + 1
            if right >= end:
                at = p
                continue
            hit = pair_of(sym[p] * n + sym[right])
            if hit is None or hit[0] != rank:
                at = p
                continue
            g, sym[p] = p, hit[1]
            right += 1
            while True:
                before = pair_of(sym[kept[-1]] * n + sym[g], nothing) if kept and sym[kept[-1]] >= 0 else nothing
                after = pair_of(sym[g] * n + sym[right], nothing) if right < end and sym[right] >= 0 else nothing
                if before[0] <= rank and before[0] <= after[0]:
                    g = kept.pop()
                    sym[g] = before[1]
                elif after[0] <= rank:
                    sym[g] = after[1]
                    right += 1
                else:
                    break
            heads.append(g)
            kept.append(g)
            at = right
        kept.extend(range(at, end))
        new = np.zeros(b - a, bool)
        new[kept] = True
        stay[a:b] = new
        symbols[a:b] = sym
        touched[a + np.array([h for h in heads if new[h]], np.int64)] = True

    def _queued(self, symbols: np.ndarray, ranks: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of one word and the places of their first ones, by a queue of pairs in the order of rank and
        place. A symbol that became part of the one before it has rank -1, and so has one without a pair."""
        pair_of, n, end = self.pair_of.get, self.size, len(symbols)
        live = np.flatnonzero(ranks < NONE)
        queue = np.sort((ranks[live] << 40) | live).tolist()
        rank, piece = np.where(ranks < NONE, ranks, -1).tolist(), pieces.tolist()
        sym, after, before = symbols.tolist(), list(range(1, end + 1)), list(range(-1, end - 1))
        here, gone = (1 << 40) - 1, -2
        while queue:
            x = heappop(queue)
            at = x & here
            if rank[at] != x >> 40:
                continue
            right = after[at]
            sym[at], sym[right] = piece[at], gone
            rank[right] = -1
            right = after[at] = after[right]
            if right < end:
                before[right] = at
                hit = pair_of(sym[at] * n + sym[right]) if sym[right] >= 0 else None
            else:
                hit = None
            if hit:
                rank[at], piece[at] = hit
                heappush(queue, (hit[0] << 40) | at)
            else:
                rank[at] = -1
            left = before[at]
            if left >= 0:
                hit = pair_of(sym[left] * n + sym[at]) if sym[left] >= 0 else None
                if hit:
                    rank[left], piece[left] = hit
                    heappush(queue, (hit[0] << 40) | left)
                else:
                    rank[left] = -1
        out = np.array(sym, np.int64)
        place = np.flatnonzero(out != gone)
        return out[place], place

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The decoded texts of a batch as bytes, and the bounds of each. starts: where each text's ids begin."""
        lengths = self.raw_length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        flat = self.raw[np.repeat(self.raw_start[ids] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.append(0, ends)[np.append(starts, len(ids))]
        return flat.tobytes(), bounds


class Encoder:
    """Encodes and decodes batches of texts, with a bounded cache of known words."""

    def __init__(self, model: Model):
        self.model, self.ids, self.said = model, {}, {}
        self.names = [str(i) for i in range(model.size)]

    def learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > CACHED_WORDS:
            self.ids, self.said = {}, {}
        else:
            words = words - self.ids.keys()
        todo = sorted(words, key=len)
        for a, b in common.blocks_of([len(w) for w in todo], FLAT):
            flat, bounds = self.model.encode_flat(todo[a:b])
            said, data, at = list(map(self.names.__getitem__, flat.tolist())), flat.tobytes(), bounds.tolist()
            for w, x, y in zip(todo[a:b], at[:-1], at[1:], strict=True):
                self.ids[w] = data[4 * x : 4 * y]
                self.said[w] = ",".join(said[x:y])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """For each text its ids and these as decimals joined by commas."""
        split = [self.model.words(self.model.escaped(t)) for t in texts]
        self.learn(set().union(*split))
        ids, said = self.ids.__getitem__, self.said.__getitem__
        return [(np.frombuffer(b"".join(map(ids, ws)), np.int32), ",".join(map(said, ws))) for ws in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        flat, bounds = self.model.decode(np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)])[:-1])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out.append(flat[a + (self.model.prefix and flat[a : a + 1] == b" " and b > a) : b].decode("utf-8", "replace"))
        return out


_encoders: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """One encoder a process and model file."""
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = Encoder(Model(f.read()))
    return _encoders[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and with keep_ids the ids and the decoded text).

    model_path is a model file that is installed at the same place on every machine. Null counts as the empty text,
    which has no ids; blanks and the blank mark both decode as blanks. Repeated rows each give a row; an empty table
    gives none; other columns of the input are not looked at.
    """
    schema = SCHEMA + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model_path)
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in common.blocks_of([len(t) for t in texts], 1_500_000):
                got = encoder.encode(texts[a:b])
                back = encoder.decode([ids for ids, _ in got])
                columns = [
                    doc_ids.slice(a, b - a),
                    pa.array([len(ids) for ids, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in got]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array([ids.tolist() for ids, _ in got], pa.list_(pa.int32())), pa.array(back)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(common.trimmed(run), schema)
