"""Source and sink queries: tables are written as files to the shared folder, by the engine's sinks, and read again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import splitting as R
from tessera.plans.registry import query
from tessera.session import dealt, deleted, discarded, scratch
from tessera.sources import files as I
from tessera.sources import sinks as O
from tessera.sources.collections import Collections, hit_id, rewritten


@query("""WITH o AS (SELECT item_id, text, row_number() OVER w AS k, count(*) FILTER (item_id % 3 = 0) OVER (PARTITION BY item_id // 10 ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS blanks FROM benchmark WINDOW w AS (PARTITION BY item_id // 10 ORDER BY item_id))
SELECT item_id, (k + blanks)::BIGINT AS entry_id, text || ' x' AS text FROM o""")
def jsonl_lines(t):
    """JSON lines with physical line numbers, files of ten items: every third item is followed by a blank line, which counts."""
    path = scratch(t.spark, "lines")
    line = F.to_json(F.struct("item_id", F.struct(F.array(F.struct("text")).alias("parts"), F.lit("x").alias("tag")).alias("body")))
    rows = t.benchmark.withColumn("f", F.floor(F.col("item_id") / 10)).repartition("f").sortWithinPartitions("f", "item_id")
    rows.select(F.concat(line, F.when(F.col("item_id") % 3 == 0, "\n").otherwise("")).alias("value"), "f").write.partitionBy("f").text(path)
    got = I.field_texts(I.jsonl(t.spark, path, "item_id long"), ["body.parts[0].text", "body.none", "body.tag"])
    return got.select("data.item_id", "entry_id", "text")


@query("""WITH c AS (SELECT *, p_partkey // 100 AS doc, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS k FROM part)
SELECT 'doc ' || doc AS doc, k::BIGINT AS entry_id, p_type || ' ' || p_partkey AS text, CASE WHEN p_size % 3 = 0 THEN 'own' ELSE 'shared' END AS kind, CASE WHEN p_size % 2 = 1 THEN 'c' || p_partkey ELSE 'chunk_' || (k - 1) END AS chunk_id FROM c WHERE p_size % 5 <> 0""")
def chunked_documents(t):
    """Documents with chunks, whole files of up to a hundred parts each: places from 1, blank chunks left out, the chunk's
    metadata over the document's."""
    path = scratch(t.spark, "chunked")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    own = F.when(size % 3 == 0, F.create_map(F.lit("kind"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    said = F.when(size % 5 == 0, " \n").otherwise(F.concat(F.lit("  "), "p_type", F.lit(" "), key, F.lit("\n")))
    chunk = F.to_json(F.struct(F.when(size % 2 == 1, F.concat(F.lit("c"), key)).alias("chunk_id"), said.alias("content"), own.alias("chunk_metadata")))
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / 100).alias("f")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", chunk.alias("j")))).alias("x"))  # a hundred at most
    about = F.to_json(F.create_map(F.lit("filename"), F.concat(F.lit("doc "), F.col("f").cast("string")), F.lit("kind"), F.lit("shared")))
    chunks = F.array_join(F.transform("x", lambda x: x["j"]), ",\n")
    docs.select(F.concat(F.lit('{"document_metadata": '), about, F.lit(', "chunks": ['), chunks, F.lit("]}")).alias("value"), "f").write.partitionBy("f").text(path)
    rows = I.chunked_json(t.spark, path)
    return rows.select(F.col("metadata")["filename"].alias("doc"), "entry_id", "text", F.col("metadata")["kind"].alias("kind"), F.col("metadata")["chunk_id"].alias("chunk_id"))


@query("""SELECT 'jsonl' AS kind, 'a' || item_id // 50 AS name, (count(*) + count(*) FILTER (item_id % 7 = 1))::BIGINT AS entries, ['text'] AS fields FROM benchmark GROUP BY 2 UNION ALL SELECT 'json', 'b' || item_id // 50, count(*), ['chunks[].content'] FROM benchmark GROUP BY 2
UNION ALL SELECT 'json', 'c' || item_id, 1, ['title'] FROM benchmark UNION ALL SELECT 'other', 'd' || item_id // 50, 0, [] FROM benchmark GROUP BY 2""")
def structure_probe(t):
    """Kind, entries and text fields of JSON lines, documents with chunks, single objects and other files of benchmark items."""
    b = t.benchmark.withColumn("f", F.floor(F.col("item_id") / 50).cast("string"))
    lines = b.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("item_id", F.to_json(F.struct("item_id", "text", F.lit("x").alias("tag"))).alias("line")))).alias("x"))  # fifty at most
    said = F.array_join(F.transform("x", lambda x: F.concat(x["line"], F.when(x["item_id"] % 7 == 1, "\n").otherwise(""))), "\n")
    chunks = b.groupBy("f").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("text").alias("content"))).alias("chunks"))).alias("text"))
    name = lambda k, f, kind: F.concat(F.lit(k), f, F.lit("." + kind)).alias("path")
    files = lines.select(name("a", F.col("f"), "jsonl"), F.concat(said, F.lit("\n")).alias("text"))
    files = files.unionByName(chunks.select(name("b", F.col("f"), "json"), "text"))
    files = files.unionByName(b.select(name("c", F.col("item_id").cast("string"), "json"), F.to_json(F.struct(F.col("text").alias("title"), F.lit(1).alias("k"))).alias("text")))
    files = files.unionByName(lines.select(name("d", F.col("f"), "txt"), said.alias("text")))
    return I.probe_text(files).select("kind", F.regexp_extract("path", r"^([^.]*)", 1).alias("name"), "entries", "fields")


@query("SELECT DISTINCT n_regionkey AS region, true AS keep, 'parquet' AS extension FROM nation")
def folder_scan(t):
    """A folder tree by extension, and which of its files stay."""
    path = scratch(t.spark, "tree")
    t.nation.select("n_regionkey", "n_name").write.partitionBy("n_regionkey").parquet(path)
    found = I.retained(I.folder(t.spark, path, "parquet"), ["parquet", "mat"])
    return found.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region"), "keep", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("extension")).distinct()


@query("SELECT idx, name, v::DOUBLE AS value FROM (SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx, unnest(['time', 'x,y', 'label']) AS name, unnest([c_custkey::DOUBLE, c_acctbal, NULL]) AS v FROM customer)")
def csv_series(t):
    """CSV time series in long form, a file for each nation, rows by their physical place; cells and headers with commas."""
    path = scratch(t.spark, "series")
    rows = t.customer.select("c_nationkey", F.col("c_custkey").alias("time"), F.col("c_acctbal").alias("x,y"), F.concat("c_name", F.lit(', "so called"')).alias("label"))
    rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "time").write.option("header", "true").option("escape", '"').partitionBy("c_nationkey").csv(path)
    return I.series(t.spark, path).select("idx", "name", "value")


@query("""WITH c AS (SELECT c_custkey // 100 AS f, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS idx FROM customer)
SELECT 'run_' || f AS series_id, x.name AS name, idx, x.v AS value FROM (SELECT f, idx, unnest([{'name': 'time', 'v': c_custkey::DOUBLE}, {'name': 'balance', 'v': c_acctbal::DOUBLE}]) AS x FROM c)""")
def mat_series(t):
    """Simulation results as MAT files of level 4, of a hundred rows each, in long form."""
    from tessera.sources.mat import result_file, series_of

    def pack(key, rows):
        values = rows.sort_values("c_custkey")[["c_custkey", "c_acctbal", "c_nationkey"]].to_numpy(float)
        return pd.DataFrame({"path": [f"store/run_{key[0]}.mat"], "content": [result_file(["time", "balance", "nation"], values)]})

    rows = t.customer.select(F.floor(F.col("c_custkey") / 100).alias("f"), "c_custkey", "c_acctbal", "c_nationkey")
    files = rows.groupBy("f").applyInPandas(pack, "path string, content binary")  # a hundred rows at most
    return series_of(files, "time|bal.*")


@query("""SELECT n_regionkey AS r, string_agg('# Page ' || CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 ELSE k END || chr(10) || chr(10) || CASE WHEN n_nationkey % 3 = 0 THEN 'alt' ELSE n_name END, chr(10) || chr(10) ORDER BY n_nationkey) AS markdown
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY 1""")
def pages_markdown(t):
    """Pages as Markdown: numbers from the first column that has one, else the place; the first text that isn't empty."""
    k = F.col("n_nationkey")
    pages = t.nation.select(F.col("n_regionkey").alias("r"), "n_nationkey", F.when(k % 2 == 0, k + 100).alias("page_number"), F.lit(None).cast("long").alias("page"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("markdown"), F.lit("alt").alias("text"))
    return I.pages_to_markdown(pages, "r", "n_nationkey", ["page_number", "page"], ["markdown", "text"])


@query("SELECT c_mktsegment AS type, round(avg(c_acctbal), 2) AS mean, count(*) AS n FROM customer WHERE c_name NOT LIKE '%,%' GROUP BY 1")
def caption_sink(t):
    """Captions through the CSV sink and back: quotes, commas and line ends survive."""
    path = scratch(t.spark, "captions")
    O.write_captions(t.customer.select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("type"), F.concat(F.lit('say "'), "c_name", F.lit('", then')).alias("caption"), F.col("c_acctbal").alias("confidence")), path)
    back = t.spark.read.option("header", "true").option("escape", '"').csv(path)
    good = F.col("caption") == F.concat(F.lit('say "'), "path", F.lit('", then'))
    return back.where(good).groupBy("type").agg(F.round(F.avg(F.col("confidence").cast("double")), 2).alias("mean"), F.count("*").alias("n"))


@query("SELECT doc_id, source, sha256('# ' || source || chr(10) || chr(10) || text) AS sha FROM documents")
def document_sink(t):
    """Processed documents as JSON lines and Markdown, read again and joined."""
    path = scratch(t.spark, "documents")
    O.write_documents(t.documents.select(F.col("doc_id").alias("document_id"), "source", F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("markdown")), path)
    a, b = t.spark.read.schema("document_id long, source string").json(f"{path}/json"), O.read_markdown(t.spark, path)
    return a.join(b, a["document_id"].cast("string") == b["id"]).select(F.col("document_id").alias("doc_id"), "source", F.sha2("markdown", 256).alias("sha"))


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_id_guard(t):
    """Ids that rows share; the sink refuses these rows before it writes any."""
    rows = t.orders.select(F.col("o_custkey").alias("id"), "o_orderkey")
    try:
        O.write_unique_jsonl(rows, scratch(t.spark, "guarded"))
    except O.DuplicateIds:
        return O.duplicate_ids(rows)
    return rows.limit(0).select("id", F.lit(0).cast("long").alias("n"))


@query("""SELECT event_type AS name, max(event_id) FILTER (event_id % 2 = 0)::BIGINT AS even, count(*) FILTER (event_id % 2 = 0) AS n_even, (SELECT count(*) FROM events) + 0 AS points, min('chunk:events:' || event_id) AS first_hit FROM events GROUP BY 1""")
def collection_upsert(t):
    """A collection created, filled and upserted: even ids are replaced by a newer text, odd ones stay."""
    held = Collections(t.spark, scratch(t.spark, "collections"))
    held.create("rag_documents_events", 2)
    held.create("empty", 2, v2=True)
    point = t.events.select(F.col("event_id").cast("string").alias("id"), F.array(F.lit(1.0), F.col("value")).cast("array<float>").alias("embedding"), F.lit("old").alias("text"), F.col("event_type").alias("source_file"), F.col("event_id").alias("entry_id"))
    assert held.upsert("rag_documents_events", point) and not held.upsert("empty", point.withColumn("embedding", F.lit(None).cast("array<float>")))
    held.upsert("rag_documents_events", point.where("entry_id % 2 = 0").withColumn("text", F.lit("new")))
    p = held.points("rag_documents_events")
    n = p.agg(F.count("*").alias("points"))
    new = F.col("text") == "new"
    out = p.groupBy(F.col("source_file").alias("name")).agg(F.max(F.when(new, F.col("entry_id"))).alias("even"), F.count_if(new).alias("n_even"), F.min(hit_id(F.lit("rag_documents_events"), F.col("entry_id"))).alias("first_hit"))
    return out.crossJoin(n)  # one row


@query("""SELECT 1 AS version, count(*) AS rows_written, count(*) AS points, 0 AS newer FROM events UNION ALL SELECT 2, count(*) FILTER (event_id % 100 = 7), count(*), count(*) FILTER (event_id % 100 = 7) FROM events
UNION ALL SELECT 3, 5, count(*) + 5, count(*) FILTER (event_id % 100 = 7) + 5 FROM events""")
def collection_history(t):
    """Versions of a collection: what each upsert wrote, and what a reader of that version sees."""
    held = Collections(t.spark, scratch(t.spark, "collections"))
    held.create("c", 1)
    point = t.events.select(F.col("event_id").cast("string").alias("id"), F.lit("old").alias("text"), F.col("event_id").alias("entry_id"))
    fresh = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("new").alias("text"))
    for part in (point, point.where("entry_id % 100 = 7").withColumn("text", F.lit("new")), fresh.limit(5)):
        held.upsert("c", part)
    out, before = None, set()
    for v in held.versions("c"):
        files = {f for x in held.manifest("c", v)["layers"].values() for f in x}
        written = held.files("c", sorted(files - before)).agg(F.count("*").alias("rows_written"))
        seen = held.points("c", v).agg(F.count("*").alias("points"), F.count_if(F.col("text") == "new").alias("newer"))
        row = written.join(seen).withColumn("version", F.lit(v))  # one row each
        out, before = row if out is None else out.unionByName(row), files
    return out.select("version", "rows_written", "points", "newer")


@query("SELECT 'nations' AS name, count(*) AS points, 3 AS size, false AS v2 FROM nation UNION ALL SELECT 'regions', count(*), 2, true FROM region UNION ALL SELECT 'zero', 0, 1, false")
def collection_info(t):
    """The collections of a root with their points and settings."""
    held = Collections(t.spark, scratch(t.spark, "collections"))
    for name, size, v2 in (("regions", 2, True), ("nations", 3, False), ("zero", 1, False)):
        held.create(name, size, v2)
    point = lambda df, k: df.select(F.col(k).cast("string").alias("id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit("t").alias("text"))
    held.upsert("regions", point(t.region, "r_regionkey"))
    held.upsert("nations", point(t.nation, "n_nationkey"))
    return held.info().select("name", "points", "size", "v2")


@query("""SELECT c_custkey, CASE WHEN contains(f, 'ast_packages') OR f = 'packages.jsonl' THEN 'packages' WHEN contains(f, 'ast_functions') THEN 'functions' WHEN contains(f, 'ast_equations') THEN 'equations' WHEN ends_with(f, '.json') THEN 'pdf' WHEN ends_with(f, '.jsonl') THEN 'unknown' END AS collection
FROM (SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN 'ast_packages_1.jsonl' WHEN 1 THEN 'packages.jsonl' WHEN 2 THEN 'my_ast_functions.jsonl' WHEN 3 THEN 'ast_equations.jsonl' WHEN 4 THEN 'book.json' ELSE 'other.jsonl' END AS f FROM customer)""")
def route_by_type(t):
    """The collection of a file by its base name; other JSON lines are unknown, other files have none."""
    k = F.col("c_nationkey") % 6
    f = F.when(k == 0, "a/AST_packages_1.jsonl").when(k == 1, "packages.jsonl").when(k == 2, "x/my_ast_functions.jsonl").when(k == 3, "ast_equations.jsonl").when(k == 4, "y/book.json").otherwise("ast/other.jsonl")
    return t.customer.select("c_custkey", I.collection_of(f).alias("collection"))


@query("SELECT n_nationkey, '{\"nodes\": [{\"config\": {\"target_collections\": [\"rag_documents_ast_packages\", \"' || n_name || '\"]}}]}' AS config, true AS changed FROM nation")
def rename_collections(t):
    """Configurations with an old collection's name replaced wherever targets are named."""
    said = F.concat(F.lit('{"nodes": [{"config": {"target_collections": ["rag_documents_ast", "'), "n_name", F.lit('"]}}]}'))
    run = F.udf(lambda s: rewritten(s), "config string, changed boolean", useArrow=True)
    return t.nation.select("n_nationkey", run(said).alias("r")).select("n_nationkey", "r.config", "r.changed")


@query("SELECT n_name AS key, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'env' END, CASE WHEN n_nationkey % 3 = 0 THEN 'file' END, 'default') AS value FROM nation")
def config_precedence(t):
    """Settings from a file over defaults, and the environment's over both."""
    path = scratch(t.spark, "config")
    k = F.col("n_nationkey")
    t.nation.where(k % 3 == 0).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.lit("file")))).alias("m")).select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    base = t.nation.select(F.col("n_name").alias("key"), F.lit("default").alias("value"))
    return I.settings(base, path, t.nation.where(k % 4 == 0).select(F.col("n_name").alias("key"), F.lit("env").alias("value")))


def code_records(t):
    """Code records from orders: an order is a package, its lines are its models, every seventh a function; each statement
    of a package has a line."""
    key, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    value = F.concat_ws(" + ", *[F.col(c).cast("string") for c in ("l_quantity", "l_partkey", "l_extendedprice")])
    model = F.concat(F.lit("model L"), line, F.lit("\n  Real q = "), value, F.lit(";\nend L"), line, F.lit(";"))
    first = F.col("l_linenumber").cast("long") * 4 + 1000
    item = lambda text, at: F.struct(text.alias("str"), F.array(F.lit("q"), F.lit("if")).alias("vars"), F.array().cast("array<string>").alias("ops"), at.alias("first_line"), at.alias("last_line"))
    block = lambda text, at: F.struct(F.lit("equation").alias("section_type"), at.alias("first_line"), at.alias("last_line"), F.array(item(text, at)).alias("items"))
    none = F.array().cast("array<struct<name:string, type:string, prefixes:array<string>>>")
    comps = F.array(F.struct(F.lit("u").alias("name"), F.lit("Real").alias("type"), F.array(F.lit("input")).alias("prefixes")), F.struct(F.lit("v").alias("name"), F.lit("Real").alias("type"), F.array(F.lit("flow")).alias("prefixes")))
    lines = t.lineitem.select(
        F.concat(F.lit("P"), key, F.lit(".L"), line).alias("fqn"), F.when(F.col("l_linenumber") == 7, "function").otherwise("model").alias("kind"), F.array(F.concat(F.lit("P"), key)).alias("package_path"), model.alias("code_text"),
        first.alias("first_line"), (first + 2).alias("last_line"), F.lit("1.0").alias("version"), comps.alias("components"), F.array(F.lit("Base")).alias("extends"), F.array(block(F.lit("q = 1;"), first + 1)).alias("equations"),
    )
    own = dealt(t.lineitem.select("l_orderkey", "l_linenumber", model.alias("code")), t.lineitem.count(), "l_orderkey")
    parts = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "code"))).alias("c"))
    text = F.concat(F.lit("package P\n\n\n"), F.array_join(F.transform("c", lambda x: F.concat(x["code"], F.lit("\n"))), "\n"), F.lit("equation\n  total = a + b;\nend P;"))
    last = F.size(F.split(text, "\n")).cast("long")
    package = parts.select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("fqn"), F.lit("package").alias("kind"), F.array().cast("array<string>").alias("package_path"), text.alias("code_text"), F.lit(1).cast("long").alias("first_line"), last.alias("last_line"),
        F.lit("1.0").alias("version"), none.alias("components"), F.array().cast("array<string>").alias("extends"), F.array(block(F.lit("q = 1;"), F.lit(1005).cast("long")), block(F.lit("total = a + b;"), F.lit(2).cast("long"))).alias("equations"),
    )
    return lines.unionByName(package)


@query("""SELECT 'packages' AS name, count(DISTINCT l_orderkey) + count(*) FILTER (l_linenumber <> 7) AS rows, 0 AS duplicates FROM lineitem UNION ALL SELECT 'functions', count(*) FILTER (l_linenumber = 7), 0 FROM lineitem
UNION ALL SELECT 'equations', count(DISTINCT l_orderkey) + count(*), 0 FROM lineitem""")
def split_outputs(t):
    """Packages, functions and equations of code records, written and counted by the sink."""
    outputs, folder = R.split_outputs(code_records(t)), scratch(t.spark, "split")
    stats = O.write_split_outputs(outputs, folder)
    discarded(outputs["packages"], outputs["functions"])
    deleted(t.spark, folder)
    return t.spark.createDataFrame([(n, s["rows"], s["duplicate_ids"]) for n, s in stats.items()], "name string, rows long, duplicates int")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT 'P' || l_orderkey AS fqn, count(*) AS children, count(*) AS removed, count(*) FILTER (l_linenumber = 7) * 0 AS functions FROM l GROUP BY 1""")
def package_children(t):
    """Packages with their children's code cut out, and the equations of these dropped."""
    p = R.package_records(code_records(t), only="kind = 'package'")
    return p.select("fqn", F.size("child_classes").cast("long").alias("children"), F.size("child_classes_removed").cast("long").alias("removed"), "contained_functions").withColumnRenamed("contained_functions", "functions")


@query("SELECT 'P' || l_orderkey || '.L' || l_linenumber AS fqn, ['u'] AS inputs, ['Base', 'Modelica.Icons.Function'] AS extends, (l_linenumber * 4 + 1001)::BIGINT AS line, ['q'] AS vars FROM lineitem WHERE l_linenumber = 7")
def function_records(t):
    """Functions: inputs and outputs, the function base class, one algorithm block."""
    f = R.function_records(code_records(t))
    item = F.get(F.get("equations", F.lit(0))["items"], F.lit(0))
    return f.select("fqn", F.transform("components", lambda c: c["name"]).alias("inputs"), "extends", item["first_line"].alias("line"), item["vars"].alias("vars"))


@query("SELECT 'package' AS kind, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'model', count(*) FROM lineitem WHERE l_linenumber = 1")
def record_envelopes(t):
    """One record of each kind and order as a JSON envelope; those that break a rule have an error instead."""
    r = R.package_records(code_records(t), only="kind = 'package' or fqn like '%.L1'").select("id", "fqn", "kind", "code_text", "statistics")
    e = R.envelope(r, ["package", "model", "function"]).where("error is null")
    return e.groupBy(F.get_json_object("json", "$.collections.ast_record.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS package, p_size % 3 AS k, count(*) AS n, count(DISTINCT p_type)::BIGINT AS children FROM part GROUP BY 1, 2")
def package_summary(t):
    """Symbols of each package by kind, with the number of packages below."""
    return t.part.groupBy(F.col("p_brand").alias("package"), (F.col("p_size") % 3).alias("k")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("children"))


@query("SELECT kind, n, pos FROM (SELECT kind, n, row_number() OVER (ORDER BY n DESC, kind) AS pos FROM (SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1))")
def histogram_order(t):
    """A histogram in the order of its counts."""
    from tessera.operators.align import positions

    h = t.part.groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("down", -F.col("n"))
    return positions(h, ["down", "kind"], "pos").select("kind", "n", "pos")


@query("SELECT kind, id FROM (SELECT 'packages' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'functions', s_suppkey FROM supplier UNION ALL SELECT 'equations', p_partkey FROM part)")
def three_way_union(t):
    parts = [t.customer.select(F.lit("packages").alias("kind"), F.col("c_custkey").alias("id")), t.supplier.select(F.lit("functions").alias("kind"), "s_suppkey"), t.part.select(F.lit("equations").alias("kind"), "p_partkey")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def sample_rows(t):
    """A sample for an audit: as many rows as asked for, between 1 and 1000, the first by id."""
    return I.sample(t.documents.select("doc_id", "lang"), 100, "doc_id")
