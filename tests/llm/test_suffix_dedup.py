import hashlib
import random
import re
from collections import Counter

import pytest

from tessera.llm import common, suffix_dedup
from tessera.llm.suffix_dedup import byte_tokens, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(texts, span=51):
    words = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    seen = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    return [len({k for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for k in range(i, i + span)}) for w in words]


def brute(texts, span=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i : i + span]) for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[hash(d[i : i + span])] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), bytes(gone).replace(b"\0\0", b"\0").count(b"\0\1") + gone[:1].count(1), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, lo long").repartition(parts)
    got = Counter(tuple(r) for r in remove_repeats(df).collect())
    texts = [t for _, t in rows]
    assert got == Counter((i, *b, n) for (i, _), b, n in zip(rows, brute(texts), brute_words(texts), strict=True))


def test_passages_and_copies(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéf") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n)[:size] for n, size in ((200, 399), (200, 400), (200, 401), (300, 700), (900, 2500))]
    texts = [text(r.randint(1, 300)) + r.choice(passages) + text(r.randint(0, 200)) + r.choice(["", *passages]) for _ in range(40)]
    for _ in range(30):
        t = r.choice(texts)
        at = r.randrange(len(t))
        texts.append(t[:at] + r.choice(["x", "", "é"]) + t[at + r.randint(0, 2) :])
    texts += ["a b " * 25 + "a", "A B " * 25 + "a", "the 51 words " * 17, "x\n" * 50, passages[1].upper() + " end", text(60)]
    texts += [None, "", "a" * 399, "a" * 400, "b" * 1300, "c" * 401, "ab" * 700, texts[0], texts[0], passages[3], passages[3][:399], " \n" * 900]
    rows = list(enumerate(texts)) + [(None, texts[1]), (None, texts[1]), (7, texts[7]), (7, texts[8])]
    check(spark, rows)


def test_long_texts_in_chunks(spark, monkeypatch):
    r = random.Random(8)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = part(1500)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    texts = [part(1700) + shared + part(3000) + shared[300:1200] + part(100), shared + part(900), part(5000)]
    got = [x for b in (suffix_dedup.chunks(byte_tokens([t.encode() for t in texts]), 400)) for x in b[3][b[1]].tolist()]
    assert sorted(got) == sorted(i for t in texts for i in range(len(t) - 399))
    check(spark, list(enumerate(texts)), 1)


def test_texts_over_a_real_chunk(spark):
    """Workers don't see a patched CHUNK: texts over 1 MiB, whose anchors have windows on both sides of the boundary."""
    r = random.Random(5)
    part = lambda n: "".join(r.choices("ab", k=n))
    shared = part(900)
    texts = [part(suffix_dedup.CHUNK + r.randint(2000, 5000)) for _ in range(3)]
    at = suffix_dedup.CHUNK - 500
    texts[2] = texts[2][:at] + shared + texts[2][at:]
    check(spark, list(enumerate([*texts, part(50) + shared])), 1)


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing(spark, rows):
    check(spark, rows) if rows else None
    assert remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_whole_table(spark, sf):
    common.arrow_limits(spark)
    docs = common.table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs).collect()}
    texts = [t for _, t in rows]
    assert got == {i: (*b, n) for (i, _), b, n in zip(rows, brute(texts), brute_words(texts), strict=True)}
