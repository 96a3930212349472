import hashlib
import random
from collections import Counter

import pytest

from tessera.llm.exact_dedup import CuckooIndex, build_index, content_of, delete_rows, exact_dedup, insert_rows, text_digests


def test_index_against_dict():
    r, index, want = random.Random(3), CuckooIndex(buckets=2), {}
    for step in range(30_000):
        key = hashlib.sha256(str(r.randrange(4000)).encode()).digest()
        if r.random() < 0.7:
            assert index.insert(key, step) == (key not in want)
            low, n = want.get(key, (step, 0))
            want[key] = (min(low, step), n + 1)
        else:
            assert index.delete(key) == (key in want)
            if key in want:
                low, n = want.pop(key)
                if n > 1:
                    want[key] = (low, n - 1)
    assert {k: tuple(e) for k, e in index.items()} == want and index.size == len(want)
    assert all(index.get(k) == e for k, e in want.items()) and index.get(b"\0" * 32) is None


def test_edges(spark):
    rows = [(5, "a b", "q"), (2, "a\t\n b", None), (2, "a b", "q"), (9, None, "q"), (7, "", "q"), (None, "a b", "q"), (4, " ", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    assert got == Counter([(5, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 2, 4, False), (9, 7, 2, False), (7, 7, 2, True), (4, 4, 1, True)])
    assert exact_dedup(docs.limit(0)).count() == 0


def test_maintenance(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    rows = lambda *r: text_digests(spark.createDataFrame(r, "doc_id long, text string"))
    index, content = build_index(text_digests(docs)), content_of(text_digests(docs))
    index, content = insert_rows(index, content, rows((4, "b"), (5, "c"), (2, "a")))
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == [(1, 3), (3, 2), (5, 1)]
    index, content = delete_rows(index, content, rows((5, "c"), (1, "a")))
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == [(2, 2), (3, 2)]
    index, content = delete_rows(index, content, rows((2, "a")))
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == [(2, 1), (3, 2)]
    assert sorted((r.doc_id, r.n) for r in content.collect()) == [(2, 1), (3, 1), (4, 1)]
    with pytest.raises(Exception, match="not live"):
        delete_rows(index, content, rows((1, "a")))[1].collect()


def test_very_long_text(spark):
    long = "word  " * 400_000
    docs = spark.createDataFrame([(1, long), (2, long.replace("  ", "\n")), (3, long + "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(docs).collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
