import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc_audit
from tessera.llm.warc_audit import audit, differing, filed, fixity_drill, leaves, parse_warc, read_manifest, read_warc, tree, write_warc

COLUMNS = "page_id long, url string, html string, file string"


def pages(spark, n=700):
    return spark.createDataFrame([(k, f"http://x/{k}", f"<p>é {k}\r\n\r\n WARC/1.1 {'y' * (k % 50)}</p>", "f") for k in range(n)], COLUMNS)


def facts(records):
    return records.select("file", "page_id", "digest", "copies", F.octet_length("record").cast("long").alias("n_bytes"))


@pytest.mark.parametrize("fanout", [8, 16])
def test_every_kind_of_damage(spark, monkeypatch, fanout):
    monkeypatch.setattr(warc_audit, "FANOUT", fanout)
    good = filed(pages(spark)).cache()
    digest = F.sha2("record", 256)
    bad = good.where("page_id <> 300").withColumn("record", F.when(F.col("page_id") == 500, F.concat("record", F.lit("!"))).when(F.col("page_id") == 650, F.regexp_replace("record", "<p>", "<q>")).otherwise(F.col("record"))).withColumn("digest", digest)
    bad = bad.unionByName(good.where("page_id = 699").withColumn("page_id", F.lit(9000).cast("long")))
    got = {r.page_id: r.status for r in audit(facts(good), facts(bad)).collect()}
    moved = [k for k in range(700) if (300 < k < 512) or (500 < k < 512)]
    want = {k: "ok" for k in range(700)} | {k: "moved" for k in moved} | {300: "missing", 500: "corrupt", 650: "corrupt", 9000: "extra"}
    assert got == want
    assert {r.status for r in audit(facts(good), facts(good)).collect()} == {"ok"}
    a = leaves(facts(good))
    assert differing(tree(a, 3), tree(a, 3)).count() == 0


def test_hot_pages_and_nulls(spark):
    rows = [(5, "u", f"body {k}", "f") for k in range(600)] + [(5, "u", "same", "f")] * 40 + [(None, None, None, None), (None, None, "x", None), (900, None, "", "f"), (7, "a\r\n\r\nb", "é\r\n\r\nWARC/1.1", "f"), (8, "u", "z" * 3_000_000, "f")]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = fixity_drill(df).collect()
    assert sum(r.copies for r in got) == len(rows) and {r.file for r in got} == {"0", "3", "null"}
    at = 0
    for r in sorted((r for r in got if r.file == "0"), key=lambda r: (r.page_id, r.record_sha256)):
        assert r.record_offset == at
        at += (r.n_bytes + 4) * r.copies
    assert fixity_drill(spark.createDataFrame([], COLUMNS)).count() == 0


def test_files_round_trip(spark, tmp_path):
    write_warc(filed(pages(spark, 30)), str(tmp_path / "warc"))
    got = {r.record_id: (r.url, bytes(r.body).decode()) for r in read_warc(spark, str(tmp_path / "warc")).collect()}
    assert got == {f"<urn:page:{r.page_id}>": (r.url, r.html) for r in pages(spark, 30).collect()}
    assert [p.suffix for p in (tmp_path / "warc").glob("part-*")][0] == ".gz"
    back = read_manifest(spark, str(tmp_path / "warc")).drop("first_at", "last_at")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in facts(filed(pages(spark, 30))).select(*back.columns).collect()}


RECORDS = [f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {20 + k}\r\n\r\n{'bcdfgh'[k % 6] * (20 + k)}\r\n\r\n".encode() for k in range(40)]


def audited(spark, tmp_path, stored):
    """Status of each page after the archive with all records, one gzip member each, is replaced by other bytes."""
    for name, data in (("good", b"".join(map(gzip.compress, RECORDS))), ("bad", stored)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(data)
    rows = audit(read_manifest(spark, str(tmp_path / "good")), read_manifest(spark, str(tmp_path / "bad"))).collect()
    return {r.page_id: r.status for r in rows}


def damaged(k, change, packed=True):
    out = [gzip.compress(x) if packed else x for x in RECORDS]
    out[k] = change(out[k])
    return b"".join(out)


def swap(old, new):
    return lambda record: record.replace(old, new)


ALL = dict.fromkeys(range(40), "ok")
LOST = dict.fromkeys(range(40), "missing")


@pytest.mark.parametrize(
    "stored, changed",
    [
        (damaged(9, swap(b"Length: 29", b"Length: x9"), False), ALL | {9: "corrupt"}),
        (damaged(9, swap(b"Length: 29", b"Length: 99"), False), ALL | {9: "corrupt"}),
        (damaged(9, swap(b"Content-Length", b"Content-Lengxx"), False), ALL | {9: "corrupt"}),
        (damaged(9, swap(b"WARC/1.1", b"XARC/1.1"), False), ALL | {9: "missing", None: "unreadable"} | dict.fromkeys(range(10, 40), "moved")),
        (damaged(0, swap(b"WARC/1.1", b"\0ARC/1.1"), False), dict.fromkeys(range(1, 40), "moved") | {0: "missing", None: "unreadable"}),
        (b"".join(map(gzip.compress, [*RECORDS[:5], RECORDS[6], RECORDS[5], *RECORDS[7:]])), ALL | {5: "moved", 6: "moved"}),
        (b"".join(RECORDS[:20]), ALL | dict.fromkeys(range(20, 40), "missing")),
        (b"no archive at all", LOST | {None: "unreadable"}),
        (b"", LOST),
    ],
)
def test_damage_that_leaves_the_rest(spark, tmp_path, stored, changed):
    assert audited(spark, tmp_path, stored) == changed


@pytest.mark.parametrize(
    "stored",
    [
        damaged(9, lambda m: m[:30] + bytes([m[30] ^ 255]) + m[31:]),  # a flipped byte in a gzip member
        damaged(9, lambda m: m[:-12]),  # a member that lacks its end
        b"".join(map(gzip.compress, RECORDS))[:-200],  # the archive is cut
        gzip.compress(b"".join(RECORDS))[:-60],  # its only member is cut
    ],
)
def test_damage_to_compressed_bytes(spark, tmp_path, stored):
    """What stands before the damage is ok, what is lost is told, and other members are read."""
    got = audited(spark, tmp_path, stored)
    lost = {k for k, v in got.items() if v in ("corrupt", "missing", "unreadable")}
    assert lost and set(got) - {None} == set(range(40)) and all(got[k] == "ok" for k in range(9))
    assert len(stored) < 1500 or len(lost - {None}) < 10


def test_reversed_replica(spark, tmp_path):
    got = audited(spark, tmp_path, b"".join(map(gzip.compress, RECORDS[::-1])))
    assert set(got.values()) == {"moved"} and set(got) == set(range(40))


def test_parse():
    data = b"WARC/1.1\r\nContent-Length: 3\r\n\r\na\xff\xfe\r\n\r\n"
    whole = [(0, b"a\xff\xfe"), (len(data), b"a\xff\xfe")]
    for stored in (data * 2, gzip.compress(data * 2), gzip.compress(data) + gzip.compress(data), (data * 2)[:-4]):
        assert [(at, body) for at, _, _, body in parse_warc(stored)] == whole
    assert [r for _, _, r, _ in parse_warc(iter([data[:9], data[9:30], data[30:]]))] == [data[:-4]]
    short = b"WARC/1.1\r\nContent-Length: 0\r\n\r>\r\n\r\n"
    records = [r for _, _, r, _ in parse_warc(data[:-5] + data[-4:] + short + data + short, strict=False)]
    assert records == [data[:-5], short[:-4], data[:-4], short[:-4]]
    for broken in (data[:-7], b"x" + data, gzip.compress(data)[:-12], b"WARC/1.1\r\nno end"):
        with pytest.raises((ValueError, zlib.error)):
            list(parse_warc(broken))
