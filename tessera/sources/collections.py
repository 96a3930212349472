"""Vector collections as Parquet files below a root: create, upsert by id, compact, search, list, describe; rewriting names.

A collection is dealt into buckets by id. An upsert adds one file to each bucket that it touches, a layer, so what it
writes grows with the batch. A manifest lists the layers of every bucket; the next version of it is the commit: it is
written aside and renamed, which fails where that version is there already. Readers take the newest manifest, so they see
one version, and files of an upsert that failed are in none. A bucket with many layers is compacted to one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import nearest, sparse

POINT = "id string, embedding array<float>, text string, source_file string, entry_id long, metadata map<string,string>, file_hash string, sparse map<string,double>"
FIELDS = [f.split(" ", 1) for f in POINT.split(", ")]
#: Buckets of a new collection, and layers that a bucket may have before it is compacted.
BUCKETS, LAYERS = 16, 8
#: How often a commit is tried when other writers come first.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Collections:
    """Collections of points below a root folder that the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = path.getFileSystem(self._conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, *parts: str) -> dict:
        path = self._path(*parts)
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, data: dict, *parts: str) -> None:
        """A new file; Conflict if it is there. It is whole once it has its name."""
        path, aside = self._path(*parts), self._path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = aside.getFileSystem(self._conf).create(aside, False)
        stream.write(json.dumps(data).encode())
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        try:
            files.rename(aside, path, how)
        except Exception as error:
            files.delete(aside, False)
            if "exist" in str(error).lower():
                raise Conflict("/".join(parts)) from error
            raise

    def create(self, name: str, size: int = 1024, v2: bool = False, buckets: int = BUCKETS) -> None:
        """A new empty collection of cosine distance; v2 has a dense and a sparse vector and 8-bit codes of the dense one."""
        if name in self.names():
            raise ValueError(f"collection {name} is there already")
        about = {"name": name, "size": size, "distance": "cosine", "v2": v2, "vectors": ["dense", "sparse"] if v2 else ["dense"], "quantisation": "int8" if v2 else None, "buckets": buckets}
        self._write(about, name, "about.json")

    def names(self) -> list[str]:
        return [n for n in self._names() if "about.json" in self._names(n)]

    def about(self, name: str) -> dict:
        return self._read(name, "about.json")

    def versions(self, name: str) -> list[int]:
        return [int(v.removesuffix(".json")) for v in self._names(name, "manifest") if v.endswith(".json") and not v.startswith(".")]

    def manifest(self, name: str, version: int | None = None) -> dict:
        """version, layers (bucket: its files, the oldest first) and streams (the number of each one's last batch)."""
        found = self.versions(name)
        if version is None and not found:
            return {"version": 0, "layers": {}, "streams": {}}
        return self._read(name, "manifest", f"{version or found[-1]:012d}.json")

    def _commit(self, name: str, change) -> dict:
        """The manifest after change(manifest), tried again on the newest one where another writer was first."""
        for _ in range(TRIES):
            now = self.manifest(name)
            new = change(json.loads(json.dumps(now)))
            if new is None:
                return now
            new["version"] = now["version"] + 1
            try:
                self._write(new, name, "manifest", f"{new['version']:012d}.json")
                return new
            except Conflict:
                continue
        raise Conflict(f"{name}: {TRIES} versions of others came first")

    def points(self, name: str, version: int | None = None) -> DataFrame:
        """The points of a version, each with its newest content."""
        return self._merged(name, list(self.manifest(name, version)["layers"].values()))

    def _merged(self, name: str, layers: list[list[str]]) -> DataFrame:
        """Points of buckets. Those with one layer are read as they are; of the others the oldest layer, by far the largest,
        loses the ids that newer ones have, and only the newer ones are shuffled."""
        alone = self.files(name, [x[0] for x in layers if len(x) == 1])
        base, newer = self.files(name, [x[0] for x in layers if len(x) > 1]), None
        for k in range(1, max([len(x) for x in layers], default=0)):  # LAYERS at most
            part = self.files(name, [x[k] for x in layers if len(x) > k]).withColumn("_layer", F.lit(k))
            newer = part if newer is None else newer.unionByName(part)
        if newer is None:
            return alone
        rest = [c for c, _ in FIELDS if c != "id"]
        newer = newer.groupBy("id").agg(F.max_by(F.struct(*rest), "_layer").alias("p")).select("id", "p.*").select(*[c for c, _ in FIELDS])
        return alone.unionByName(base.join(newer.select("id"), "id", "left_anti").select(*[c for c, _ in FIELDS])).unionByName(newer)

    def files(self, name: str, files: list[str]) -> DataFrame:
        """The rows of files of a manifest."""
        if not files:
            return self.spark.createDataFrame([], POINT)
        return self.spark.read.schema(POINT).parquet(*[f"{self.root}/{name}/data/{f}" for f in files])

    def has_data(self, name: str) -> bool:
        return name in self.names() and bool(self.manifest(name)["layers"])

    def info(self) -> DataFrame:
        """(name, points, size, distance, v2) of all collections."""
        rows = [(n, self.points(n).count(), a["size"], a["distance"], a["v2"]) for n in self.names() for a in [self.about(n)]]
        return self.spark.createDataFrame(rows, "name string, points long, size long, distance string, v2 boolean")

    def _stored(self, name: str, points: DataFrame) -> dict[str, str]:
        """Writes points by bucket; the file of each bucket that has any."""
        buckets, folder = self.about(name)["buckets"], uuid.uuid4().hex
        rows = points.select(*[c for c, _ in FIELDS], F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
        rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{self.root}/{name}/data/{folder}")
        return {d.removeprefix("bucket="): f"{folder}/{d}" for d in self._names(name, "data", folder) if d.startswith("bucket=")}

    def upsert(self, name: str, points: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Inserts points and replaces those of the same id. Points without an id get one from their content's hash. Of
        several new points of an id the one with the largest entry_id stays. In a v2 collection points without a dense
        vector are left out; without any left nothing is written and the result is False. So it is for a batch (stream,
        number) of a stream whose number is no higher than that of its last one."""
        seen = lambda m: batch is not None and m["streams"].get(batch[0], -1) >= batch[1]
        if seen(self.manifest(name)):
            return False
        new = points.select(*[F.col(c) for c in points.columns if c in dict(FIELDS)])
        for column, kind in FIELDS:
            if column not in new.columns:
                new = new.withColumn(column, F.lit(None).cast(kind))
        if self.about(name)["v2"]:
            new = new.where(F.coalesce(F.size("embedding") > 0, F.lit(False)))
        own = F.sha2(F.concat_ws("\x1f", "source_file", F.col("entry_id").cast("string"), "text"), 256)
        new = new.withColumn("id", F.coalesce("id", own))
        rest = [c for c in new.columns if c != "id"]
        new = new.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("entry_id", F.lit(-1)), F.xxhash64("text"))).alias("p")).select("id", "p.*")
        files = self._stored(name, new)
        if not files:
            return False
        done = False

        def add(m: dict) -> dict | None:
            nonlocal done
            done = not seen(m)
            if not done:
                return None
            for bucket, file in files.items():
                m["layers"].setdefault(bucket, []).append(file)
            m["streams"] |= {batch[0]: batch[1]} if batch is not None else {}
            return m

        m = self._commit(name, add)
        if max(len(x) for x in m["layers"].values()) > LAYERS:
            self.compact(name, LAYERS // 2)
        return done

    def compact(self, name: str, over: int = 1) -> int:
        """Rewrites the buckets with more than so many layers to one layer each; how many these are. Layers that others
        add meanwhile stay on top."""
        old = {b: x for b, x in self.manifest(name)["layers"].items() if len(x) > over}
        if not old:
            return 0
        files = self._stored(name, self._merged(name, list(old.values())))

        def replace(m: dict) -> dict:
            for bucket, file in files.items():
                if m["layers"][bucket][: len(old[bucket])] == old[bucket]:
                    m["layers"][bucket] = [file, *m["layers"][bucket][len(old[bucket]) :]]
            return m

        self._commit(name, replace)
        return len(old)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes the files that none of the newest versions (keep of them) has, and older manifests; how many folders
        go. Not while an upsert is under way."""
        versions = self.versions(name)[-keep:]
        used = {f for v in versions for x in self.manifest(name, v)["layers"].values() for f in x}
        gone = [f"{d}/{b}" for d in self._names(name, "data") for b in self._names(name, "data", d) if b.startswith("bucket=") and f"{d}/{b}" not in used]
        old = [f"{v:012d}.json" for v in self.versions(name) if v not in versions]
        for parts in [*(("data", g) for g in gone), *(("manifest", m) for m in old)]:
            path = self._path(name, *parts)
            path.getFileSystem(self._conf).delete(path, True)
        return len(gone)

    def search(self, name: str, queries: DataFrame, k: int, quantised: bool = False, more: float = 3.0) -> DataFrame:
        """The k nearest points, by entry_id, of each query (query_id, query_vec): exact, or by the 8-bit codes of a v2
        collection and exact again for more * k candidates."""
        points, about = self.points(name), self.about(name)
        if not quantised:
            return nearest.nearest(points, queries, k, id_col="entry_id")
        if not about["v2"]:
            raise ValueError(f"collection {name} isn't quantised")
        codes, how = nearest.quantised(points, about["size"], id_col="entry_id")
        return nearest.nearest_quantised(codes, how, points, queries, k, more, id_col="entry_id")

    def search_sparse(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        """The k points, by entry_id, with the highest dot product of their sparse vectors with each query (query_id, sparse)."""
        if not self.about(name)["v2"]:
            raise ValueError(f"collection {name} has no sparse vector")
        return sparse.search(sparse.postings(self.points(name), "entry_id"), queries, k).withColumnRenamed("id", "entry_id")


def hit_id(collection: Column, entry_id: Column, prefix: str = "rag_documents_") -> Column:
    """``chunk:<collection without its prefix>:<entry id>``."""
    return F.concat(F.lit("chunk:"), F.replace(collection, F.lit(prefix), F.lit("")), F.lit(":"), entry_id.cast("string"))


def rewritten(config: str, old: str = "rag_documents_ast", new: str = "rag_documents_ast_packages") -> tuple[str, bool]:
    """A configuration with the old name replaced in every ``target_collections``, and whether any was. A node's may be
    a value or a list; elsewhere only a value counts."""
    data, changed = json.loads(config), False

    def walk(at, in_node: bool) -> None:
        nonlocal changed
        for key, value in at.items() if isinstance(at, dict) else enumerate(at):
            if key == "target_collections":
                if isinstance(value, dict) and value.get("value") == old:
                    value["value"], changed = new, True
                elif isinstance(value, list) and in_node and old in value:
                    at[key], changed = [new if v == old else v for v in value], True
            elif isinstance(value, (dict, list)):
                walk(value, in_node or key == "nodes")

    walk(data, False)
    return json.dumps(data, ensure_ascii=False), changed
