"""URL filters (12): sorted digest arrays over rules and lists of hosts.

The keys of rules are hosts and, for each host, beginnings of paths. Both kinds are 64-bit xxhash digests in sorted
arrays, with the full strings beside them, in files that Spark ships to every machine and that its workers map into
memory, so that all of them share one copy in the page cache. A batch of addresses is judged in two probes: the suffixes
of its hosts among the hosts, then, for each host found, the path's beginnings of just the lengths which that host's
rules have. A probe is one vectorised binary search; rows with an equal digest are compared with the stored string, so
that a collision decides nothing. Addresses aren't shuffled, and each is judged by itself.

A file holds PART keys at most, those of a range of digests; rules and lists of any length are so many files, made one
after the other. What the driver holds is one of them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

SEED = 42  # Spark's own xxhash64 has this seed
#: Keys of a file.
PART = 2_000_000
ALLOW, BLOCK = "allow", "block"
#: (host, beginning of the path, verdict): the query's rules.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]
#: Hosts that are blocked, with all below them, where no rule fits: the query's list.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets") for top in ("com", "net", "org")]
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key, SEED)


def flat(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bytes): one array of all bytes, and where each string begins, with the end last."""
    return np.cumsum([0, *map(len, strings)], dtype=np.int64), np.frombuffer(b"".join(strings), np.uint8)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """The arrays in one file: a line of JSON, then each at a multiple of 8 bytes."""
    at, head, body = 0, {}, []
    for name, x in arrays.items():
        data = x.tobytes() + bytes(-x.nbytes % 8)
        head[name] = (x.dtype.str, len(x), at)
        at += len(data)
        body.append(data)
    line = json.dumps(head).encode()
    return line + b" " * (-(len(line) + 1) % 8) + b"\n" + b"".join(body)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, as views of its memory map."""
    whole = np.memmap(path, np.uint8, "r")
    with open(path, "rb") as f:
        line = f.readline()
    return {name: whole[len(line) + at : len(line) + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in json.loads(line).items()}


class DigestArray:
    """Strings by their digests: digests (sorted), starts and bytes of the strings; other arrays go by row."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.digests, self.starts, self.bytes = arrays["digests"], arrays["starts"], arrays["bytes"]

    def find(self, strings: Sequence[bytes], digests: np.ndarray) -> np.ndarray:
        """The row of each string, or -1."""
        found = np.full(len(strings), -1, np.int64)
        if not len(strings) or not len(self.digests):
            return found
        at = np.searchsorted(self.digests, digests)
        starts, data = flat(strings)
        todo = np.arange(len(strings))
        while len(todo):  # once, and once more for each further string of an equal digest
            inside = at[todo] < len(self.digests)
            inside[inside] = self.digests[at[todo][inside]] == digests[todo][inside]
            todo = todo[inside]
            if not len(todo):
                break
            rows = at[todo]
            size = starts[todo + 1] - starts[todo]
            same = self.starts[rows + 1] - self.starts[rows] == size
            some, own = todo[same], rows[same]
            size = size[same]
            if len(some):
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                equal = data[np.repeat(starts[some], size) + step] == self.bytes[np.repeat(self.starts[own], size) + step]
                wrong = np.bincount(np.repeat(np.arange(len(some)), size), ~equal, len(some)) > 0
                found[some[~wrong]] = own[~wrong]
            todo = todo[found[todo] < 0]
            at[todo] += 1
        return found


def digest_arrays(keys: Sequence[bytes], values: dict[str, Sequence], bits: int = 64) -> dict[str, np.ndarray]:
    """Arrays of a DigestArray over distinct keys; values: further columns by key, a list of numbers each for "lengths".

    bits: only so many bits of a digest count, for tests of collisions.
    """
    digests = np.array([digest(k) >> (64 - bits) for k in keys], np.uint64)
    order = np.argsort(digests, kind="stable").tolist()
    starts, data = flat([keys[k] for k in order])
    arrays = {"digests": digests[order], "starts": starts, "bytes": data}
    for name, column in values.items():
        if name == "lengths":
            lists = [sorted(column[k]) for k in order]
            arrays |= {"lengths": np.array([x for xs in lists for x in xs], np.int64), "lengths_at": np.cumsum([0, *map(len, lists)], dtype=np.int64)}
        else:
            arrays[name] = np.array([column[k] for k in order], np.int64)
    return arrays


_shipped: set[tuple[str, str]] = set()


def shipped(spark: SparkSession, data: bytes) -> str:
    """Puts a file into the shared folder and on every machine; the name, by its content, under which workers find it."""
    name = f"digests-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = paths(f"{common.shared_dir(spark)}/tessera/{name}")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = folder.makeQualified(path)
    if not folder.exists(path):
        new = paths(f"{path.toString()}.{uuid.uuid4().hex}")
        out = folder.create(new, True)
        for a in range(0, len(data), 8 << 20):
            out.write(data[a : a + (8 << 20)])
        out.close()
        if not folder.rename(new, path):
            folder.delete(new, False)
    if (spark.sparkContext.applicationId, name) not in _shipped:
        spark.sparkContext.addFile(path.toString())
        _shipped.add((spark.sparkContext.applicationId, name))
    return name


class Index:
    """Names of the files of both kinds of keys, with the number of leading digest bits that choose a file, and the bytes of
    the longest host."""

    def __init__(self, hosts: list[str], keys: list[str], host_bits: int, key_bits: int, bits: int, longest: int):
        self.files = {"hosts": (hosts, host_bits), "keys": (keys, key_bits)}
        self.bits, self.longest = bits, longest

    def find(self, kind: str, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(file, row) of each string; file is -1 where no key is equal."""
        names, lead = self.files[kind]
        full = np.array([digest(s) for s in strings], np.uint64)
        part = (full >> np.uint64(64 - lead)).astype(np.int64) if lead else np.zeros(len(strings), np.int64)
        file, row = np.full(len(strings), -1), np.full(len(strings), -1, np.int64)
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            got = self.part(kind, p).find([strings[k] for k in own.tolist()], full[own] >> np.uint64(64 - self.bits))
            row[own] = got
            file[own[got >= 0]] = p
        return file, row

    def part(self, kind: str, p: int) -> DigestArray:
        name = self.files[kind][0][p]
        if name not in _mapped:
            _mapped[name] = DigestArray(mapped(SparkFiles.get(name)))
        return _mapped[name]


_mapped: dict[str, DigestArray] = {}


def build_index(rules: DataFrame, bits: int = 64, part: int = PART) -> Index:
    """The index of (host, path, verdict, listed): rules, and entries of a list where listed is true.

    Hosts have A-Z lower-cased. Of rules with the same host and path a block counts before an allow. Null counts as empty; a host with / or a path that begins otherwise fits no address and is left out.
    """
    spark = rules.sparkSession
    rules = rules.select(common.ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == BLOCK).alias("block"), "listed")
    rules = rules.where("not contains(host, '/') and (path = '' or startswith(path, '/'))")
    rule = F.when(~F.col("listed"), F.when(F.col("block"), 2).otherwise(1)).otherwise(0)  # 1: allow, 2: block
    keys = common.written(rules.groupBy("host", "path").agg(F.max(rule).alias("rule"), F.max(F.col("listed").cast("int")).alias("listed")), "rules")
    hosts = keys.groupBy("host").agg(F.collect_set(F.octet_length("path").cast("long")).alias("lengths"))
    made = {}
    for kind, rows in (("hosts", hosts.select(F.col("host").alias("key"), "lengths")), ("keys", keys.select(F.concat("host", "path").alias("key"), F.octet_length("host").cast("long").alias("host_size"), "rule", "listed"))):
        n = rows.count()
        lead = max(0, int(np.ceil(np.log2(max(1, n / part)))))
        names = []
        for p in range(1 << lead):
            own = rows.where(F.shiftrightunsigned(F.xxhash64("key"), 64 - lead) == p) if lead else rows
            found = own.collect()
            columns = {"lengths": [r["lengths"] for r in found]} if kind == "hosts" else {c: [r[c] for r in found] for c in ("host_size", "rule", "listed")}
            names.append(shipped(spark, packed(digest_arrays([r["key"].encode() for r in found], columns, bits))))
        made[kind] = names, lead
    longest = keys.agg(F.max(F.octet_length("host"))).first()[0]
    common.dropped(keys)
    return Index(made["hosts"][0], made["keys"][0], made["hosts"][1], made["keys"][1], bits, -1 if longest is None else longest)


def suffixes(host: bytes, longest: int) -> list[bytes]:
    """Of the host and what follows each of its dots, what has up to longest bytes; no longer one can be a rule's."""
    out, at = [host] if len(host) <= longest else [], host.find(b".", max(0, len(host) - longest - 1))
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(b".", at + 1)
    return out


def judged(index: Index, hosts: list[bytes], paths: list[bytes]) -> tuple[list[str | None], list[str], list[str | None]]:
    """(rule, verdict, entry of a list) of each address; the verdict is None where neither is found."""
    n = len(hosts)
    number: dict[bytes, int] = {}
    host_of = np.array([number.setdefault(h, len(number)) for h in hosts], np.int64)
    of, names = [], []  # distinct hosts and their suffixes
    for h, k in number.items():
        for s in suffixes(h, index.longest):
            of.append(k)
            names.append(s)
    file, row = index.find("hosts", names)
    hits: list[list[tuple[bytes, np.ndarray]]] = [[] for _ in number]
    for k in np.flatnonzero(file >= 0).tolist():
        a = index.part("hosts", int(file[k])).arrays
        at = int(row[k])
        hits[of[k]].append((names[k], a["lengths"][a["lengths_at"][at] : a["lengths_at"][at + 1]]))
    owner, keys = [], []
    for k, (h, path) in enumerate(zip(host_of.tolist(), paths, strict=True)):
        for name, lengths in hits[h]:
            for size in lengths.tolist():
                if size > len(path):
                    break
                owner.append(k)
                keys.append(name + path[:size])
    rules: list[str | None] = [None] * n
    verdicts: list[str] = [""] * n
    entries: list[str | None] = [None] * n
    file, row = index.find("keys", keys)
    best, widest = [(0, 0)] * n, [-1] * n
    for k in np.flatnonzero(file >= 0).tolist():
        a, at, own = index.part("keys", int(file[k])).arrays, int(row[k]), owner[k]
        rule, host_size = int(a["rule"][at]), int(a["host_size"][at])
        if rule and (len(keys[k]), host_size) > best[own]:
            best[own] = len(keys[k]), host_size
            rules[own], verdicts[own] = keys[k].decode(), (ALLOW, BLOCK)[rule - 1]
        if a["listed"][at] and host_size > widest[own]:
            widest[own], entries[own] = host_size, keys[k].decode()
    return rules, [v or (BLOCK if e is not None else ALLOW) for v, e in zip(verdicts, entries, strict=True)], entries


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame, listed: Sequence[str] | DataFrame) -> DataFrame:
    """(host, path, verdict, listed) of rules (host, path, verdict) and of a list of hosts."""
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    listed = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(h,) for h in listed], "host string")
    entries = listed.select("host", F.lit("").alias("path"), F.lit(BLOCK).alias("verdict"), F.lit(True).alias("listed"))
    return rules.select("host", "path", "verdict", F.lit(False).alias("listed")).unionByName(entries)


def url_verdicts(urls: DataFrame, index: Index, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per address: page_id, host, path, rule, verdict, listed (the list's host that it is or is below).

    The longest rule that fits decides, of equally long ones that of the longer host; where none fits, an address is
    blocked if its host is on the list, and allowed if not. An address that is null or has no :// has an empty host and
    path, no rule and the verdict allow; a path that is empty doesn't begin with /. Repeated rows each give a row, an
    empty table gives none; other columns are not looked at.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = urls.select(F.col(id_col).cast("long").alias("page_id"), common.ascii_lower(F.regexp_extract(url, ADDRESS, 1)).alias("host"), F.regexp_extract(url, ADDRESS, 2).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = ([x.encode() for x in batch.column(c).to_pylist()] for c in (1, 2))
            rules, verdicts, listed = judged(index, hosts, paths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(listed, pa.string())], ["page_id", "host", "path", "rule", "verdict", "listed"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, listed string")


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    hosts = ", ".join(f"('{h}')" for h in LISTED)
    return rf"""
WITH rules(h, p, v) AS (VALUES {rules}), hosts(h) AS (VALUES {hosts}),
u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{common.UPPER}', '{common.LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, (SELECT max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS found,
  (SELECT max_by(h, length(h)) FROM hosts WHERE host = h OR ends_with(host, '.' || h)) AS listed FROM a)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed FROM b
"""
