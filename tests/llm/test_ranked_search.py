import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in dict.fromkeys(items):
        if text is not None:
            asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, q in asked.items():
        rows = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in q.items() if t in c)
            if s > 0:
                rows.append((-s, 2**70 if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    index = rs.build_index(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank int").repartition(3))
    return sorted((tuple(r) for r in rs.search(index, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int"), **how).collect()), key=str)


EDGES = [
    None, "", "...", "A a a B", "b", "the the the", "Ünïcode ünïcode É é", "İstanbul K K", "x1y2 X1Y2", "no-break space", "你好 你好 мир", "the quick brown fox", "quick, quick: quick!", "nul\0nul", "tab\tline\nfeed",
]


def test_edges(spark):
    docs = [(i, t) for i, t in enumerate(EDGES)] + [(None, "the quick fox"), (None, "the quick fox"), (3, "A a a B"), (3, "a"), (-5, "the fox")]
    items = [(1, "the quick fox a"), (1, "the quick fox a"), (1, "B"), (2, "the the é K"), (3, None), (4, ""), (5, "unknown words"), (None, "quick x1y2 ünïcode 你好"), (7, "你好 nul tab feed no-break space")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=2, first=1, per_group=2) == brute(docs, items, 2)
    assert found(spark, docs[:3], items) == [] == found(spark, docs, []) == found(spark, [], items) == found(spark, docs, [(4, "")])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    """Skewed words, groups of equal documents, and blocks of 16 documents, most of which are left out."""
    monkeypatch.setattr(rs, "DOCS", 16)
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(2000)]
    text = lambda n: " ".join(vocabulary[min(1999, int(r.paretovariate(0.6)) - 1)] for _ in range(n))
    docs = [(i, text(r.choice([0, 3, 30, 60]))) for i in range(1200)]
    docs += [(2000 + i, docs[r.randrange(20)][1]) for i in range(300)]
    r.shuffle(docs)
    items = [(k, r.choice([text(8), docs[r.randrange(len(docs))][1], docs[r.randrange(20)][1]])) for k in range(40)]
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_are_left_out():
    """A bound is no less than any score of its block; blocks below the threshold aren't scored, and ties go by id."""
    np, n = rs.np, 3000
    best = rs.Best(2)
    best.add(np.array([5, 9, 7]), np.array([1, 2, 3]), np.array([False] * 3))
    assert (best.score, best.last) == (7, 3) and best.below(6, 0) and best.below(7, 4) and not best.below(7, 3) and not best.below(8, 9)
    items = rs.Items([(1, [b"rare common"]), (2, [b"common"])]).weigh({0: 1000, 1: 3}, n)
    counts = [[Counter({b"common": 1 + (b + k) % 3}) | (Counter({b"rare": 1}) if b == 7 and k < 3 else Counter()) for k in range(10)] for b in range(100)]
    blocks = [rs._block(b, [b * 10 + k for k in range(10)], c, n, 2 * n) for b, c in enumerate(counts)]
    batch = rs.pa.Table.from_batches(blocks).combine_chunks().to_batches()[0]
    bounds, places = rs._bounds(batch, items, items.terms())
    for b in range(100):
        rows = {c: rs._lists(blocks[b].column(c), np.int64)[0] for c in ("m", "starts", "term", "tf")}
        made = rs.Block(rows, places[b], blocks[b].column("ids")[0].values, 2)
        assert made.scores(items.term[:2], items.weights[:2]).max() <= bounds[0, b] > 0
    held = [rs.Best(3), rs.Best(3)]
    scored = rs.scan(batch, items, items.terms(), held)
    assert sorted(held[0].rows[:, 1].tolist()) == [70, 71, 72] and scored == 1 + 1 and held[1].rows[:, 1].tolist() == [2, 5, 8]


def test_very_long_text(spark):
    docs = [(1, "alpha beta " * 400_000), (2, "alpha " + " ".join(f"t{k}" for k in range(300_000))), (3, "beta gamma"), (4, "delta")]
    items = [(1, "alpha gamma"), (2, " ".join(f"t{k}" for k in range(0, 300_000, 3)) + " delta")]
    assert found(spark, docs, items) == brute(docs, items)


def test_row_groups_of_an_index_are_bounded(spark, monkeypatch):
    """A reader of the blocks holds a row group's rows at once, and a file has as many blocks as its task made."""
    import pyarrow.parquet as pq

    from tessera.llm import ranked_search as R

    monkeypatch.setattr(R, "GROUP", 1 << 14, raising=False)
    docs = spark.range(6000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), x -> concat('w', x * id))) as text").coalesce(1)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in R.build_index(docs).blocks.inputFiles()]
    rows = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(rows) > 40 and max(rows) <= 20
