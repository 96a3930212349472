"""Containment by fingerprints and ordered suppression in rounds, against brute force on random input."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.apart import kept_apart
from tessera.operators.containment import CLASSES, SHORT, contained, fingerprints, hashes


def test_fingerprints_of_a_part_are_those_of_the_text():
    r = random.Random(1)
    for k, width in CLASSES:
        text = "".join(r.choice("abcé😀 ") for _ in range(400))
        for _ in range(60):
            a = r.randrange(400)
            part = text[a : a + r.randint(1, 120)]
            got = fingerprints(part, k, width)
            assert set(got.tolist()) <= set(fingerprints(text, k, width).tolist()) and bool(len(got)) == (len(part) >= k + width - 1)
    h = hashes("abcabc", 3)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3 and len(hashes("ab", 3)) == 0 == len(hashes("", 3))
    x = np.array([int(v) for v in hashes("xyz" * 9, 12)], dtype=object)
    assert fingerprints("xyz" * 9, 12, 16).tolist() == [np.uint64(min(x[:16])).view(np.int64)]


@pytest.mark.parametrize("seed", [1, 2])
def test_contained(spark, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "😀", "%", "_", "\\", "'", "\n"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [text(r.choice([0, 1, 5, 60, 200])) for _ in range(60)] + [None, "", "same text here", "same text here"]
    parts = [x[a : a + n] for _ in range(150) for x in [r.choice([t for t in texts if t])] for a in [r.randrange(len(x))] for n in [r.choice([1, 2, 5, 8, 9, 10, 26, 27, 28, 90])]]
    parts += [text(6) for _ in range(30)] + [None, "", "same", "same", "x" * 500]
    rows = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "id int, text string, part string").repartition(3)
    some = spark.createDataFrame(list(enumerate(parts)), "id int, part string")
    got = Counter((x[0], x[3]) for x in contained(rows, "text", some.withColumnRenamed("id", "pid"), "part").collect())
    assert got == Counter((i, j) for i, t in enumerate(texts) for j, p in enumerate(parts) if t and p and p in t) and len(got) > 300
    assert contained(rows, "text", some.limit(0), "part").count() == 0 == contained(rows.limit(0), "text", some, "part").count()
    assert {len(p) < SHORT for p in parts if p} == {True, False}


def test_many_parts(spark):
    """More parts than the join took before, and a text that holds all of them."""
    parts = spark.range(12_000).selectExpr("id", "concat('part number ', id * 7919, ' of the list') AS part")
    rows = spark.createDataFrame([(1, " | ".join(f"part number {k * 7919} of the list" for k in range(12_000))), (2, "part number 7919 of the list"), (3, "part number 7918 of the list")], "k int, text string")
    got = Counter(x.k for x in contained(rows, "text", parts, "part").select("k").collect())
    assert got == {1: 12_000, 2: 1}


def fold(items):
    """Items (id, grams) in their order, one by one."""
    kept = []
    for i, g in items:
        if not any(g and len(g & k) >= max(1, len(g) // 2) for _, k in kept):
            kept.append((i, g))
    return [i for i, _ in kept]


@pytest.mark.parametrize("seed, common", [(1, 0.0), (2, 0.5), (3, 1.0)])
def test_kept_apart(spark, seed, common):
    r = random.Random(seed)
    rows = []
    for k in range(500):
        n = r.choice([0, 1, 2, 3, 4, 6, 10])
        g = {f"g{min(60, int(r.paretovariate(0.5)))}" for _ in range(n)} | ({"hot"} if n and r.random() < common else set())
        rows.append((k, k % 3 if k % 7 else None, r.randrange(100), sorted(g) if n or k % 2 else None, "x"))
    df = spark.createDataFrame(rows, "id int, list int, turn int, grams array<string>, at string").repartition(4)
    got = {x.id for x in kept_apart(df, ["list"], ["turn", "id"], "grams").collect()}
    want = set()
    for part in {x[1] for x in rows}:
        want |= set(fold([(i, set(g or [])) for _, i, g in sorted((t, i, g or []) for i, p, t, g, _ in rows if p == part)]))
    assert got == want
    alone = {x.id for x in kept_apart(df, [], ["turn", "id"], "grams").collect()}
    assert alone == set(fold([(i, set(g or [])) for _, i, g in sorted((t, i, g or []) for i, _, t, g, _ in rows)]))


@pytest.mark.parametrize("held", [0, 60, 10_000])
def test_kept_apart_long_lists(spark, held, monkeypatch):
    """Lists that a task may hold and those that go in rounds give the same; null grams count for nothing."""
    from tessera.operators import apart

    monkeypatch.setattr(apart, "ROWS", held)
    r = random.Random(held)
    rows = [(k, min(int(r.paretovariate(0.7)), 9), r.randrange(30), sorted({f"g{r.randrange(12)}" for _ in range(r.choice([0, 1, 2, 4, 7]))}) + [None] * (k % 3 == 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, list int, turn int, grams array<string>").repartition(4)
    got = kept_apart(df, ["list"], ["turn", "id"], "grams").collect()
    want = set()
    for part in {x[1] for x in rows}:
        want |= set(fold([(i, set(g) - {None}) for _, i, g in sorted((t, i, g) for i, p, t, g in rows if p == part)]))
    assert {x.id for x in got} == want and len(got) == len(want)
    assert all(tuple(x) == rows[x.id] for x in got)


def test_short_lists_are_shuffled_once(spark):
    """Grams of lists that a task can hold are no rows of joins."""
    df = spark.createDataFrame([(k, k // 3, [f"p{k}", f"p{k + 1}"]) for k in range(12)], "turn int, list int, grams array<string>")
    kept = kept_apart(df, ["list"], ["turn"], "grams")
    said = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in said and said.count("Repartition") == 1
    assert sorted(x.turn for x in kept.collect()) == [0, 2, 3, 5, 6, 8, 9, 11]
    texts = df.selectExpr("turn", "list", "concat_ws(' ', grams) as text")
    made = kept_apart(texts, ["list"], ["turn"], F.split("text", " "))
    said = made._jdf.queryExecution().optimizedPlan().toString()
    assert said.index("split(") < said.index("Repartition")  # grams are made above the shuffle
    assert sorted(map(tuple, made.collect())) == sorted((x.turn, x.list, " ".join(x.grams)) for x in kept.collect())
    assert sorted(x.turn for x in kept_apart(texts, [], ["turn"], F.split("text", " ")).collect()) == [0, 2, 4, 6, 8, 10]


def test_kept_apart_edges(spark):
    df = spark.createDataFrame([(1, ["a b"]), (1, ["a b"]), (2, ["a b", "c d", "e f", "g h"]), (3, []), (3, None), (None, ["c d", "x y"])], "turn int, grams array<string>")
    got = sorted(((x.turn or 0), x.grams) for x in kept_apart(df, [], ["turn"], "grams").collect() if x.grams)
    assert got == [(0, ["c d", "x y"]), (1, ["a b"])] or got == [(0, ["c d", "x y"]), (1, ["a b"]), (2, ["a b", "c d", "e f", "g h"])]
    assert kept_apart(df.limit(0), [], ["turn"], "grams").count() == 0
    chain = spark.createDataFrame([(k, [f"p{k}", f"p{k + 1}"]) for k in range(12)], "turn int, grams array<string>")  # each decides the next
    assert sorted(x.turn for x in kept_apart(chain, [], ["turn"], "grams").collect()) == [0, 2, 4, 6, 8, 10]
