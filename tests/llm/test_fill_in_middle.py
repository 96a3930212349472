import hashlib
import re
from collections import Counter

import pytest

from tessera.llm.fill_in_middle import checked, fill_in_middle, restored


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "a", "word", "two words", "x<P>y", "<S>", "<M> <M>", "<P", "S>", "<<P>>", "<", "a<S b> M>", "\n\r\n\t", "naïve café 1234", "😀 emoji 👨‍👩‍👧 joined", "é combining", "nul\0inside", "“quoted” – dash",
    "don't it's", "a" * 5000, "ab1" * 4000, " line", "中文字符 mixed 한국어", "%' \\ \" $p $seed",
]


def test_against_brute_force(spark):
    rows = [(i * 7 + j, t, "other") for j in range(7) for i, t in enumerate(TEXTS)] + [(None, "null id here", "o"), (3, "same id", "o"), (3, "same id", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    got = Counter(tuple(r) for r in fill_in_middle(docs).collect())
    assert got == Counter((i, *brute(i, t)) for i, t, _ in rows)
    forms = Counter(k[2] for k in got)
    assert min(forms[x] for x in ("plain", "psm", "spm")) >= 10
    digests = Counter(tuple(r) for r in fill_in_middle(docs, digests=True).collect())
    assert digests == Counter((i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t or "")) for i, t, _ in rows)
    back = Counter(tuple(r) for r in restored(fill_in_middle(docs)).collect())
    assert back == Counter((i, t or "") for i, t, _ in rows)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    texts = ["word, " * 900_000, "x" * 3_000_000, "é1" * 1_500_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(fill_in_middle(docs, digests=True).collect())
    assert [tuple(r) for r in got] == [(i, *brute(i, t)[:4], sha(brute(i, t)[4]), sha(t)) for i, t in enumerate(texts)]


def test_parameters(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "doc_id long, text string")
    assert {r.form for r in fill_in_middle(docs, plain=0, spm=100).collect()} == {"spm"}
    assert {r.form for r in fill_in_middle(docs, plain=100).collect()} == {"plain"}
    made = fill_in_middle(docs, seed="other", plain=0, marks=("[[pre]]", "[[suf]]", "[[mid]]"))
    assert sorted(tuple(r) for r in restored(made, ("[[pre]]", "[[suf]]", "[[mid]]")).collect()) == [(i, f"text number {i}") for i in range(200)]
    for marks in (("", "b", "c"), ("ab", "xabx", "c"), ("ab", "ba", "c"), ("aa", "b", "c"), ("x", "x", "y")):
        with pytest.raises(ValueError, match="told apart"):
            checked(marks)
