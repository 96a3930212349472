import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.url_filter import LISTED, RULES, DigestArray, build_index, digest, digest_arrays, mapped, packed, rule_table, suffixes, url_verdicts


def brute(url, rules=RULES, listed=LISTED):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    below = lambda h: host == h or host.endswith("." + h)
    found = max(((len((h + p).encode()), len(h.encode()), v == "block", h + p, v) for h, p, v in rules if below(h) and path.startswith(p)), default=None)
    entry = max((h for h in listed if below(h)), key=len, default=None)
    return host, path, found and found[3], found[4] if found else "block" if entry is not None else "allow", entry


URLS = [
    None, "", "no address", "://", "http://", "http:///es/1", "https://Example.ORG", "https://example.org/", "https://example.org/es", "https://EXAMPLE.org/ES/1", "https://a.b.example.org/es/x?y#z", "http://example.org/en/1",
    "http://example.org/en/12?x", "http://xexample.org/en/12", "http://example.org./en/1", "http://example.org:80/es/", "http://u@example.org/es/", "http://spam-farm.example.com/en/1", "http://www.spam-farm.example.com/de/1",
    "http://www.spam-farm.example.org/en/2", "http://www.spam-farm.example.net", "http://spam-farm.example.net?/x", "http://nospam-farm.example.net/", "http://com/fr/", "http://com/frx", "x://y://org/fr/", "http://org#/es/", "http://org/\n/es?",
    "http://example.com/" + "de/" * 30_000, "http://é.example.org/es/é", "http://" + "a." * 5000 + "org/", "://org/x", "ORG://ORG/ORG", "http://.org/", "http://..org/", "http://org/%2Fes/",
]


def test_against_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://org/", "x", "y"), (3, "http://a.org/", "x", "y"), (3, "http://a.org/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    index = build_index(rule_table(spark, RULES, LISTED))
    assert Counter(tuple(r) for r in url_verdicts(pages, index).collect()) == Counter((i, *brute(u)) for i, u, _, _ in rows)
    assert url_verdicts(pages.limit(0), index).count() == 0
    nothing = build_index(rule_table(spark, [], []))
    assert {(r.rule, r.verdict, r.listed) for r in url_verdicts(pages, nothing).collect()} == {(None, "allow", None)}


@pytest.mark.parametrize("bits", [64, 3])
def test_many_rules_in_many_files(spark, bits):
    """800 rules and 300 listed hosts in files of 100 keys; with 3 bits nearly all digests collide."""
    r = random.Random(bits)
    label = lambda: r.choice(["a", "b", "cc", "dé", "x-y"])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    path = lambda n: "".join("/" + r.choice(["a", "bb", "é", "1"]) for _ in range(r.randint(0, n)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(), path(3)) for _ in range(800))}.values())
    listed = sorted({host() for _ in range(300)})
    urls = [f"http://{host()}{path(5)}{r.choice(['', '/', '?q', '#f'])}" for _ in range(3000)]
    index = build_index(rule_table(spark, rules, listed), bits=bits, part=100)
    assert len(index.files["keys"][0]) > 4 and len(index.files["hosts"][0]) > 1
    got = url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), index).collect()
    assert [tuple(x)[1:] for x in sorted(got)] == [brute(u, rules, listed) for u in urls]


def test_long_addresses(spark):
    """Hosts and paths of a megabyte, with half a million dots."""
    urls = ["http://" + "a." * 500_000 + "org/es/", "http://" + "b" * 1_000_000 + ".org/", "http://x.org/" + "es/" * 300_000, "http://" + "." * 500_000 + "spam-farm.example.net/", "x" * 1_000_000 + "://org/"]
    got = url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), build_index(rule_table(spark, RULES, LISTED)))
    assert [tuple(r)[1:] for r in sorted(got.collect())] == [brute(u) for u in urls]
    assert suffixes(b"a.bb.c", 1) == [b"c"] and suffixes(b"a.bb.c", 4) == [b"bb.c", b"c"] and suffixes(b"a.bb.c", 6) == [b"a.bb.c", b"bb.c", b"c"] and suffixes(b"", 0) == [b""] and suffixes(b"a.", -1) == suffixes(b"", -1) == []


def test_repeated_rules(spark):
    rules = [("Org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("org", None, "allow"), ("a.or", "g/", "block"), ("a.org/", "", "block")]
    got = url_verdicts(spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.org"), (3, "http:///")], "page_id long, url string"), build_index(rule_table(spark, rules, ["org", "org", "ORG"])))
    assert sorted(tuple(r)[3:] for r in got.collect()) == [("/", "block", None), ("org", "allow", "org"), ("org/", "block", "org")]


def test_digests_and_file(spark, tmp_path):
    words = [f"w{k}" * (k % 40) for k in range(5000)] + ["é", ""]
    words = sorted(set(words))
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    assert all(digest(x.w.encode()) == x.h % 2**64 for x in got)
    keys = [w.encode() for w in words[::2]]
    (tmp_path / "f").write_bytes(packed(digest_arrays(keys, {"rank": range(len(keys))}, bits=4)))
    index = DigestArray(mapped(str(tmp_path / "f")))
    assert isinstance(index.digests.base, np.memmap) or isinstance(index.digests, np.memmap)
    asked = [w.encode() for w in words]
    rows = index.find(asked, np.array([digest(w) >> 60 for w in asked], np.uint64))
    assert [int(index.arrays["rank"][k]) if k >= 0 else None for k in rows] == [keys.index(w) if w in keys else None for w in asked]
