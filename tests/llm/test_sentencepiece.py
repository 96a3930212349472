import hashlib
import random
import time

import pytest

from tessera.llm.queries import tokenizer_path
from tessera.llm.sentencepiece_bpe import encode_documents, load

spm = pytest.importorskip("sentencepiece")
EDGES = ["", " ", "  a ", "a\n\nb\t c", "▁x", "ｆｕｌｌ é\xa0x", "\x00a", "<s>hi</s>", " " * 100, " " * 57 + "the end", "aaaa" * 500, "执行中文日本語テスト😀" * 30]


def _random_texts(n):
    r = random.Random(5)
    letters, parts = "abcdethe ▁\n　执行éßtion###$$$  ingr", ["the", "th", "he", "▁", "  ", "a", "ing", "in", "g", "tion"]
    return ["".join(r.choice(letters if k % 2 else parts) for _ in range(r.randint(1, 150))) for k in range(n)]


def test_equals_library():
    path = tokenizer_path()
    lib, own = spm.SentencePieceProcessor(model_file=path), load(path)
    texts = EDGES + _random_texts(1500)
    got = own.encode(texts)
    back = own.decode([ids for ids, _ in got])
    for t, (ids, said), b in zip(texts, got, back, strict=True):
        want = lib.encode(t)
        assert ids.tolist() == want and said == ",".join(map(str, want)) and b == lib.decode(want)


@pytest.mark.parametrize("make", [lambda r, n: "e" * n, lambda r, n: "the" * (n // 3), lambda r, n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n)), lambda r, n: "".join(r.choices("etaoin", k=n)), lambda r, n: "the " * (n // 4), lambda r, n: "-=" * (n // 2), lambda r, n: "ab" * (n // 4) + "执" + "0" * (n // 4) + "#" * (n // 4)])
def test_long_runs(make):
    """A megabyte without a blank takes seconds: time in proportion, and the ids of the library."""
    path = tokenizer_path()
    lib, own = spm.SentencePieceProcessor(model_file=path), load(path)
    for n in (997, 1_000_000):
        text = make(random.Random(n), n)
        began = time.time()
        ids, _ = own.encode([text])[0]
        assert time.time() - began < 20
        assert ids.tolist() == lib.encode(text)


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the end", None), (3, "the end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in encode_documents(docs, tokenizer_path()).collect()}
    assert got == {(1, 0, hashlib.sha256(b"").hexdigest()), (2, 0, hashlib.sha256(b"").hexdigest()), (3, 2, hashlib.sha256(b"the end").hexdigest())}
    assert encode_documents(docs.limit(0), tokenizer_path()).count() == 0
    kept = encode_documents(docs, tokenizer_path(), keep_ids=True).where("doc_id = 3").first()
    assert kept.decoded == "the end" and len(kept.ids) == 2
