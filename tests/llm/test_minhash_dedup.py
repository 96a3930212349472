import random
import re

import pytest

from tessera.llm import common, minhash_dedup
from tessera.llm.components import components
from tessera.llm.minhash_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _components(nodes, edges):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, words, percent):
    sets = {}
    for i, text in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, _components(sets, links)


def test_components_of_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(4000, 4200)]
    got = {x.node: x.component_id for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = _components({n for e in edges for n in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("words", "block"), [(2, 512), (2, 4), (5, 9)])
def test_against_brute_force(spark, monkeypatch, words, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "CROWD", 2 if block < 10 else 24)
    r = random.Random(words)
    docs, base = [], [" ".join(r.choice("abcdefghij") * r.randint(1, 3) + str(r.randrange(50)) for _ in range(r.randint(1, 120))) for _ in range(25)]
    for _ in range(160):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
            w[r.randrange(len(w))] = "new" + str(r.randrange(9))
        docs.append(" ".join(w).upper() if r.random() < 0.3 else "\n".join(w))
    docs = list(enumerate([*docs, None, "", " \t", "one", "One", "two words", "TWO  words", "x " * 3000, "x " * 2000]))
    r.shuffle(docs)
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, id int").repartition(3)
    sizes, parts = brute(docs, words, 80)
    got = {x.doc_id: x for x in near_duplicates(df, words, 80).collect()}
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (sizes[i], parts[i], parts[i] == i) for i in sizes}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c"), (2, "a b c"), (2, "d e f"), (3, "d e f"), (None, "a b c"), (4, "z")]
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_sizes(spark, sf):
    common.arrow_limits(spark)
    docs = common.table(spark, sf, "documents")
    sizes, parts = brute([(x.doc_id, x.text) for x in docs.collect()], 2, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(docs, 2, 80).collect()}
    assert got == {i: (sizes[i], parts[i]) for i in sizes}
