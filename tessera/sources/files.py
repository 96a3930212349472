"""Readers of text, JSON, JSON lines, CSV series and page lists, each a DataFrame of a path that Spark can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, line) of all text files of a path, with physical line numbers from 1.

    Files are read in splits like any text table. A line's number is its place in its split plus the lines of the splits
    before, which are counted per split; so a file never has to fit in a task.
    """
    split = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("at")]
    lines = spark.read.text(path).select(F.col("value").alias("line"), *split, F.monotonically_increasing_id().alias("place"))
    splits = lines.groupBy("source_file", "at").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    both = lines.join(splits, ["source_file", "at"])
    return both.select("source_file", (F.col("place") - F.col("first") + F.col("before") + 1).cast("long").alias("line_no"), "line")


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """(source_file, entry_id, raw, data) of JSON lines; blank lines are skipped but counted, so entry_id is the line
    number. Without a schema it is taken from the lines; a line that isn't JSON has null data."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    if schema is None:
        schema = spark.read.json(path).schema
    if isinstance(schema, T.StructType):
        schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    return rows.select("source_file", F.col("line_no").alias("entry_id"), F.col("line").alias("raw"), F.from_json("line", schema).alias("data"))


def nested(raw: Column, path: str) -> Column:
    """The value at a path such as ``a.b[0].c`` of a JSON text; null where a step is missing. Any index means the first
    element, as in the reference's reader."""
    out = "$"
    for step in path.split("."):
        name, _, index = step.partition("[")
        out += f"['{name}']" + ("[0]" if index else "")
    return F.get_json_object(raw, out)


def field_texts(rows: DataFrame, fields: list[str], raw: str = "raw") -> DataFrame:
    """Adds text: the string values at the fields, joined by a blank; rows without any are left out."""
    said = []
    for f in fields:
        value = nested(F.col(raw), f)
        said.append(F.when(value != "", value))
    return rows.withColumn("text", F.concat_ws(" ", *said)).where("text <> ''")


def overlay(first: Column, second: Column) -> Column:
    """Two maps as one; where both have a key the second's value stays."""
    first, second = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (first, second))
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


CHUNKED = "document_metadata map<string,string>, chunks array<struct<chunk_id:string, content:string, chunk_metadata:map<string,string>>>"


def chunked_json(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, entry_id, text, metadata) of JSON documents with chunks; a document is a row, blank chunks go.

    entry_id is the chunk's place from 1; metadata is the document's, the chunk's over it, and the chunk id.
    """
    return chunk_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.from_json("value", CHUNKED).alias("d")))


def chunk_rows(whole: DataFrame) -> DataFrame:
    """The chunks of documents (source_file, d), where d is a document of the form CHUNKED."""
    rows = whole.select("source_file", F.col("d.document_metadata").alias("doc"), F.posexplode("d.chunks").alias("at", "c"))
    said = F.regexp_replace("c.content", r"^\s+|\s+$", "")
    own = F.create_map(F.lit("chunk_id"), F.coalesce("c.chunk_id", F.concat(F.lit("chunk_"), F.col("at").cast("string"))))
    return rows.where(said != "").select("source_file", (F.col("at") + 1).cast("long").alias("entry_id"), said.alias("text"), overlay(overlay(F.col("doc"), F.col("c.chunk_metadata")), own).alias("metadata"))


def generic_json(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, entry_id, raw) of JSON files without chunks: an object is one row, a list one row per element."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.trim("value").alias("value"))
    items = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = whole.where(F.get_json_object("value", "$.chunks").isNull()).select("source_file", F.posexplode(items).alias("at", "raw"))
    return rows.select("source_file", (F.col("at") + 1).cast("long").alias("entry_id"), "raw")


def folder(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """(path, name, length, modified) of all files below a folder with an extension; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def retained(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Adds keep: whether a file of a listing stays, by its extension. Nothing is deleted."""
    return files.withColumn("keep", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lstrip(".") for e in extensions]))


def text_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, expression) of all string leaves of a schema; of lists of structs the first element, as ``key[0]``."""
    out: list[tuple[str, str]] = []

    def walk(kind: T.DataType, said: str, column: str) -> None:
        if isinstance(kind, T.StringType):
            out.append((said, column))
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{said}.{f.name}" if said else f.name, f"{column}.`{f.name}`" if column else f"`{f.name}`")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            walk(kind.elementType, f"{said}[0]", f"get({column}, 0)")

    walk(schema, "", prefix)
    return out


def long_text_fields(df: DataFrame, least: int = 10) -> list[str]:
    """The paths of string leaves with a value of over ``least`` characters in the first row: one row comes to the driver."""
    fields = text_fields(df.schema)
    if not fields:
        return []
    row = df.limit(1).select(*[F.length(F.expr(e)).alias(f"f{k}") for k, (_, e) in enumerate(fields)]).first()
    return [said for k, (said, _) in enumerate(fields) if row and (row[k] or 0) > least]


def flattened(schema: T.StructType, column: str = "", limit: int = 100) -> Column:
    """A map of all scalar leaves of a struct by dotted keys, lists left out and strings of over ``limit`` characters too,
    with ``_original_structure``: the list of the top keys."""
    pairs: list[Column] = []

    def walk(kind: T.StructType, said: str, at: str) -> None:
        for f in kind.fields:
            key, here = f"{said}.{f.name}" if said else f.name, f"{at}.`{f.name}`" if at else f"`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, key, here)
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                pairs.extend([F.lit(key), F.col(here).cast("string")])

    walk(schema, "", column)
    top = F.create_map(F.lit("_original_structure"), F.lit(",".join(schema.fieldNames())))
    leaves = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.map_concat(F.map_filter(leaves, lambda k, v: v.isNotNull() & (F.length(v) <= limit)), top)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, kind, entries, first (the first record), fields, sha256.

    kind is jsonl, json or other; other files have no fields. fields are the string leaves of the first record of a kind
    with over ten characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return probe_text(files.select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256")))


def probe_text(files: DataFrame) -> DataFrame:
    """The probe of files whose text is at hand: (path, text, and a digest if there is one). Entries of JSON lines are its
    lines, blank ones too, and its fields those of the first; the field of a document with chunks is ``chunks[].content``."""
    spark = files.sparkSession
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = files.select("path", F.when(kind.isin("json", "jsonl"), kind).otherwise("other").alias("kind"), "text", F.col("sha256") if "sha256" in files.columns else F.sha2("text", 256).alias("sha256"))
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n")
    chunks = F.from_json(F.get_json_object("text", "$.chunks"), "array<string>")
    items = F.when(F.startswith(F.trim("text"), F.lit("[")), F.from_json("text", "array<string>")).otherwise(F.coalesce(chunks, F.array("text")))
    entries = F.when(F.col("kind") == "jsonl", F.when(F.col("text") != "", lines)).when(F.col("kind") == "json", items)
    chunked = (F.col("kind") == "json") & chunks.isNotNull()
    first = F.when(~chunked & (F.trim(F.get(entries, F.lit(0))) != ""), F.get(entries, F.lit(0)))
    rows = files.select("path", "kind", "sha256", F.greatest(F.coalesce(F.size(entries), F.lit(0)), F.lit(0)).cast("long").alias("entries"), first.alias("first"), chunked.alias("_chunked"))
    said = [r["first"] for r in rows.where("first is not null").groupBy("kind").agg(F.min_by("first", "path").alias("first")).collect()]  # two at most
    found = sorted({f for s in said for f in long_text_fields(_parsed(spark, s))})
    there = F.array_compact(F.array(*[F.when(F.length(nested(F.col("first"), f)) > 10, f) for f in found])) if found else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    return rows.withColumn("fields", F.when(F.col("_chunked"), F.array(F.lit("chunks[].content"))).when(F.col("first").isNull(), none).otherwise(there)).drop("_chunked")


def _parsed(spark: SparkSession, text: str) -> DataFrame:
    """One JSON text as a row of its own schema."""
    one = spark.createDataFrame([(text,)], "value string")
    return one.select(F.from_json("value", F.schema_of_json(text)).alias("d")).select("d.*")


def sample(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first rows of an audit's sample: n of them, between 1 and 1000."""
    return df.orderBy(order).limit(max(1, min(n, 1000)))


def collection_of(path: Column) -> Column:
    """The collection that a file goes to, by its base name; JSON is pdf, other JSON lines unknown, other files null."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    of = lambda kind: F.contains(name, F.lit(f"ast_{kind}")) | (name == f"{kind}.jsonl")
    lines = F.when(of("packages"), "packages").when(of("functions"), "functions").when(of("equations"), "equations").otherwise("unknown")
    return F.when(name.endswith(".jsonl"), lines).when(name.endswith(".json"), "pdf")


def settings(defaults: DataFrame, path: str, environment: DataFrame) -> DataFrame:
    """(key, value): defaults, over these the keys of JSON files of a path, over both the environment's."""
    read = defaults.sparkSession.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "in_file"))
    out = defaults.join(read, "key", "full_outer").join(environment.withColumnRenamed("value", "in_env"), "key", "full_outer")
    return out.select("key", F.coalesce("in_env", "in_file", "value").alias("value"))


def series(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(series_id, idx, name, value) of CSV time series with a header; series_id is the file's name without extension,
    idx its physical row. Cells that are no numbers are null."""
    lines = numbered_lines(spark, path) if encoding.upper().replace("-", "") == "UTF8" else _decoded(spark, path, encoding)
    lines = lines.withColumn("series_id", F.regexp_extract("source_file", r"([^/]+?)(?:\.[^./]*)?$", 1))
    found = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(r',\s*("(?:[^"]|"")*+"\s*|[^,]*)'), 1)  # a comma in quotes parts no cells
    cells = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r'^\s*"?|"?\s*$', ""), '""', '"'))
    lines = lines.where(F.trim("line") != "").select("source_file", "series_id", "line_no", cells.alias("cells"))
    heads = lines.where("line_no = 1").select("source_file", F.col("cells").alias("names"))
    rows = lines.where("line_no > 1").join(heads, "source_file").select("series_id", (F.col("line_no") - 2).alias("idx"), F.posexplode(F.arrays_zip("names", "cells")).alias("k", "c"))
    return rows.select("series_id", "idx", F.col("c.names").alias("name"), F.expr("try_cast(c.cells AS double)").alias("value"))


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of small files in another encoding, such as ISO-8859-1: a file is a row."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), F.decode("content", encoding).alias("text"))
    return files.select("source_file", F.posexplode(F.split("text", "\r?\n")).alias("k", "line")).select("source_file", (F.col("k") + 1).cast("long").alias("line_no"), "line")


def pages_to_markdown(pages: DataFrame, by: str, order: str, number: list[str], text: list[str]) -> DataFrame:
    """(by, markdown): the pages of a document in their order, each under ``# Page N``.

    N is the first of the number columns that isn't null, else the place from 1; the text is the first one that isn't empty.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    n = F.coalesce(*[F.col(c).cast("long") for c in number], place) if number else place
    said = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in text], F.lit(""))
    rows = pages.select(by, F.col(order).alias("o"), F.concat(F.lit("# Page "), n.cast("string"), F.lit("\n\n"), said).alias("page"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "page"))), lambda x: x["page"])
    return rows.groupBy(by).agg(F.array_join(parts, "\n\n").alias("markdown"))


def documents_to_markdown(files: DataFrame, convert, convert_page=None, pages=None) -> DataFrame:
    """(path, markdown, error) of binary files by an injected converter, as no PDF library is part of this engine.

    convert: bytes -> str. Where it fails and pages (bytes -> number of pages) is given, convert_page (bytes, k -> str)
    converts the pages one by one; pages that fail are left out, the rest are joined by a rule.
    """

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for data in batch["content"]:
                said, error = None, None
                try:
                    said = convert(bytes(data))
                except Exception as e:  # a converter may fail in any way on a broken file
                    error = f"{type(e).__name__}: {e}"
                    if pages and convert_page:
                        parts = []
                        for k in range(pages(bytes(data))):
                            try:
                                parts.append(convert_page(bytes(data), k))
                            except Exception as inner:
                                error = f"{error}; page {k + 1}: {inner}"
                        said = "\n\n---\n\n".join(parts) if parts else None
                out.append(said)
                errors.append(error)
            yield batch[["path"]].assign(markdown=out, error=errors)

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")
