"""From code files to nested records: definitions by a table function, extractors on each one's own text, a record as one
struct, and the checks of a set of records.

A file's definitions come from one pass of the lexer. Each has its own text, without the definitions in it, so what goes on
from there is no longer than the files, however deep they nest; files aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import extract as E
from tessera.functions.lexer import definitions
from tessera.operators.text import whole_json
from tessera.session import stored

STATEMENT = "str string, first_line int, last_line int"
SECTION = f"section string, initial boolean, first_line int, last_line int, statements array<struct<{STATEMENT}>>"
DEFINITION = (
    "number int, parent int, kind string, name string, scope array<string>, first_line int, last_line int, first int, last int, closed boolean, comment string, "
    f"extends array<string>, imports array<string>, declared string, own string, bare string, sections array<struct<{SECTION}>>"
)
#: What stands behind = in a list: text in quotes and one pair of brackets belong to it, a comma ends it.
VALUE = r'(?:"(?:[^"\\]++|\\.)*+"|\{[^{}]*+\}|\([^()]*+\)|[^,(){}"]++)++'
FQN = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"
# Markers of equations with their operators, attributes of declarations, what a set of records has to keep.
MARKERS = {"der(": "der", "pre(": "pre", "noEvent": "noEvent", "sample": "sample", "edge": "edge"}
QUOTED = ["unit", "displayUnit", "quantity"]
PLAIN = ["start", "min", "max", "nominal", "fixed", "stateSelect"]
VALIDATION_RULES = {"no_duplicate_id": True, "ast_required_nonempty": ["parameters", "components", "equations"], "require_provenance": True, "min_equation_vars": 2}


class Definitions:
    """Table function: a row for each definition of a text."""

    def eval(self, text: str):
        for d in definitions(text):
            sections = [(x["section"], x["initial"], x["first_line"], x["last_line"], [tuple(s.values()) for s in x["statements"]]) for x in d.pop("sections")]
            yield (*d.values(), sections)


def table_function(spark: SparkSession, name: str = "definitions"):
    """Registers the function for SQL, as in ``FROM files f, LATERAL definitions(f.code)``; Arrow carries its rows."""
    return spark.udtf.register(name, F.udtf(Definitions, returnType=DEFINITION, useArrow=True))


def symbols(files: DataFrame, code: str, keep: list[str]) -> DataFrame:
    """keep, the columns of DEFINITION, and fqn, for every definition of the files; a null text has none."""
    call = table_function(files.sparkSession)
    rows = files.select(*keep, F.col(code).alias("_code")).lateralJoin(call(F.col("_code").outer()))
    return rows.drop("_code").withColumn("fqn", F.array_join(F.concat("scope", F.array("name")), "."))


def attributes(text: Column) -> Column:
    """A map of the nine attributes in a list such as (unit="V", start=0, min=-10); text in quotes and one pair of
    brackets belongs to its value."""
    value = lambda k: F.regexp_extract(text, rf'\b{k}\s*=\s*({VALUE})', 1)
    said = [(k, F.regexp_extract(text, rf'\b{k}\s*=\s*"([^"]*)"', 1)) for k in QUOTED] + [(k, F.trim(value(k))) for k in PLAIN]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in said]), F.array(*[v for _, v in said])), lambda _, v: v != "")


def modifications(text: Column) -> Column:
    """A map of name=value in a list such as (R=100, redeclare package Medium = Water): redeclarations are redeclare_0 and
    so on, and are no values besides."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\(+|\)+$", "")
    anew = F.transform(F.regexp_extract_all(inner, F.lit(r"redeclare\s+([^,)]+)"), 1), lambda r: F.trim(r))
    pair = r'([A-Za-z_]\w*)\s*=\s*(' + VALUE + ")"
    pairs = E.matches(F.regexp_replace(inner, r"redeclare\s+[^,)]+", ""), pair, k=1, v=2)
    plain = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.trim(p["v"]).alias("v")))
    redone = F.transform(anew, lambda r, i: F.struct(F.concat(F.lit("redeclare_"), i.cast("string")).alias("k"), r.alias("v")))
    both = F.concat(redone, plain)
    last = E.bound(both, lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: y["k"] == x["k"])))
    return F.map_from_entries(last)


def equation_item(text: Column, initial: Column) -> Column:
    """(str, vars, guards, ops, phase) of a statement: sorted distinct names, guard if, the operators whose markers it
    holds, and phase initial in an initial section."""
    said = F.regexp_replace(F.trim(text), ";+$", "")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(said, F.lit(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*"), 0)))
    ops = F.array_compact(F.array(*[F.when(F.contains(said, F.lit(m)), op) for m, op in MARKERS.items()]))
    guards = F.when(F.contains(said, F.lit(" if ")), F.array(F.lit("if"))).otherwise(F.array().cast("array<string>"))
    phase = F.when(initial | F.startswith(F.lower(said), F.lit("initial")), "initial").otherwise("runtime")
    return F.struct(said.alias("str"), names.alias("vars"), guards.alias("guards"), ops.alias("ops"), phase.alias("phase"))


def _lines(first: str | Column, last: str | Column) -> Column:
    return F.struct(F.col(first).alias("start") if isinstance(first, str) else first.alias("start"), F.col(last).alias("end") if isinstance(last, str) else last.alias("end"))


def _equations() -> Column:
    """A block for each section; one without items where there is no section."""
    items = lambda s: F.transform(F.filter(s["statements"], lambda x: F.trim(x["str"]) != ""), lambda x: equation_item(x["str"], s["initial"]))
    kind = lambda s: F.concat(F.when(s["initial"], "initial_").otherwise(""), s["section"])
    blocks = F.transform("sections", lambda s: F.struct(kind(s).alias("section_type"), items(s).alias("items"), _lines(s["first_line"], s["last_line"]).alias("location")))
    none = F.array().cast("array<struct<str:string,vars:array<string>,guards:array<string>,ops:array<string>,phase:string>>")
    return F.when(F.size("sections") > 0, blocks).otherwise(F.array(F.struct(F.lit("equation").alias("section_type"), none.alias("items"), _lines("first_line", "last_line").alias("location"))))


def records(symbols: DataFrame, file_path: str, repo: str = "local", commit: str = "WORKTREE", version: str = "1.0.0", stamp: Column | None = None) -> DataFrame:
    """One nested record for each definition, with the id ``fqn|kind|version|checksum|first-last``.

    file_path: a column of symbols. The checksum is the SHA-1 of the definition's own text without annotations; code_text
    is that text, filled up to 50 characters. Declarations are read from the text without comments and sections. A stamp (such as
    current_timestamp()) becomes metadata.timestamp. Definitions that are left open are records too; used_by stays empty,
    as it would put all users of a common name into one row: graph.neighbours has these.
    """
    rows = symbols.withColumn("clean", E.annotations_removed("own")).withColumn("spoken", E.annotations_removed("bare")).withColumn("told", E.annotations_removed("declared"))
    rows = rows.withColumn("checksum", F.sha1(F.encode("clean", "UTF-8")))
    comps = F.transform(E.components(F.col("told")), lambda c: F.struct(
        c["name"].alias("name"), c["type"].alias("type"), c["prefixes"].alias("prefixes"), modifications(c["modifications"]).alias("modifications"), c["array_dims"].alias("array_dims"), c["comment"].alias("comment")))
    params = F.transform(E.parameters(F.col("told")), lambda p: F.struct(
        p["name"].alias("name"), p["type"].alias("type"), F.substring(F.regexp_replace(p["default"], r"\s+", " "), 1, 180).alias("default"), F.coalesce(p["unit"], E.unit_of(p["description"])).alias("unit"),
        p["min"].alias("min"), p["max"].alias("max"), p["description"].alias("description")))
    variables = F.transform(E.variables(F.col("told")), lambda v: F.struct(
        v["name"].alias("name"), v["type"].alias("type"), v["prefixes"].alias("prefixes"), v["binding"].alias("binding_equation"), attributes(v["attributes"]).alias("attributes"), v["comment"].alias("comment")))
    rows = rows.select(
        "*", comps.alias("components"), params.alias("parameters"), variables.alias("variables"), _equations().alias("equations"), E.connections(F.col("spoken")).alias("connections"),
        E.dependencies(F.col("spoken")).alias("dependencies"), E.documentation(F.col("own")).alias("info"))
    rid = F.concat_ws("|", "fqn", "kind", F.lit(version), "checksum", F.concat_ws("-", F.col("first_line").cast("string"), F.col("last_line").cast("string")))
    uses = F.array_sort(F.array_distinct(F.filter(F.concat("extends", "imports", "dependencies"), lambda d: d.rlike(FQN))))
    said = F.coalesce("info", F.nullif(F.trim("comment"), F.lit("")))
    domain = E.physical_domain(F.col("name"), F.array_join("scope", "."))
    stamps = [] if stamp is None else [F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")]
    size = lambda c: F.size(c).cast("long").alias(f"{c}_count")
    return rows.select(
        rid.alias("id"), "kind", "name", "fqn", F.col("scope").alias("package_path"),
        F.struct(F.col(file_path).cast("string").alias("file_path"), _lines("first_line", "last_line").alias("line_range"), *stamps, "checksum", F.col("checksum").alias("original_checksum"), F.lit(version).alias("version")).alias("metadata"),
        E.padded(F.regexp_replace("clean", r"^\s+|\s+$", "")).alias("code_text"),
        F.struct(
            F.transform("extends", lambda e: F.struct(e.alias("base_class"), F.create_map().cast("map<string,string>").alias("modifications"))).alias("extends"),
            F.transform("imports", lambda i: F.struct(i.alias("package"), F.when(F.contains(i, F.lit(".")), "qualified").otherwise("unqualified").alias("kind"))).alias("imports"),
            F.array().cast("array<struct<name:string,constrainedby:string>>").alias("replaceables")).alias("inheritance"),
        "components", "parameters", "variables", "equations", "connections",
        F.struct(uses.alias("uses"), F.array().cast("array<string>").alias("used_by")).alias("neighbors"),
        F.struct(F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), F.col(file_path).cast("string").alias("file_path"), _lines("first_line", "last_line").alias("line_range"), F.lit(version).alias("version"), F.col("checksum").alias("hash")).alias("provenance"),
        F.when(said.isNotNull(), F.struct(said.alias("info"), F.lit("").alias("revisions"))).alias("documentation"),
        F.when(domain.isNotNull(), F.struct(domain.alias("domain"))).alias("physical_domain"),
        F.struct(*[size(c) for c in ("parameters", "components", "equations", "connections", "variables")], (F.col("last_line") - F.col("first_line") + 1).cast("long").alias("code_lines")).alias("statistics"),
    )


def entries(recs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep and json: the lines of a JSONL file, each a record with the rules that a set of records has to keep."""
    rules = F.struct(*[(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in VALIDATION_RULES.items()])
    body = F.struct(F.struct(F.struct(*[c for c in recs.columns if c not in (keep or [])]).alias("ast_record")).alias("collections"), rules.alias("validation_rules"))
    return recs.select(*(keep or []), F.to_json(body).alias("json"))


def _information() -> Column:
    return F.coalesce(F.col("documentation.info"), F.lit(""))


def estimate() -> Column:
    """Bytes that a record's content takes about: name, documentation and a footprint for each of its items."""
    return F.octet_length(F.concat("kind", "name")) + F.octet_length(_information()) + 80 * (F.size("parameters") + F.size("components")) + 120 * F.size("equations")


def signature() -> Column:
    """What makes records alike: kind, name, counts and the first 512 characters of the documentation."""
    counts = [F.size(c).cast("string") for c in ("parameters", "components", "equations")]
    return F.sha1(F.encode(F.concat_ws("\x1f", "kind", "fqn", *counts, F.substring(_information(), 1, 512)), "UTF-8"))


def _counted(recs: DataFrame, key: Column) -> DataFrame:
    return recs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n"))


def issues(recs: DataFrame, most: int = 8000, params: int = 200, comps: int = 200, eqs: int = 200) -> DataFrame:
    """(level, code, message, target_id): MISSING_CORE, OVERSIZE, MANY_PARAMS, MANY_COMPONENTS and MANY_EQUATIONS of
    records, DUPLICATE_IDS and DUPLICATE_CONTENT of the set. Names and signatures are counted with partial sums. What the
    rules need is a written table, so the records are made once."""
    rows = stored(recs.select("kind", "fqn", estimate().alias("size"), *[F.size(c).alias(c) for c in ("parameters", "components", "equations")], signature().alias("signature")), "issues")
    name = F.coalesce("fqn", F.lit(""))
    rules = [
        ((name == "") | (F.coalesce("kind", F.lit("unknown")) == "unknown"), "error", "MISSING_CORE", F.lit("record without fqn or kind")),
        (F.col("size") > most, "warn", "OVERSIZE", F.concat(F.lit("estimated content "), F.col("size").cast("string"), F.lit(f" exceeds {most}"))),
        (F.col("parameters") > params, "warn", "MANY_PARAMS", F.lit("too many parameters")),
        (F.col("components") > comps, "warn", "MANY_COMPONENTS", F.lit("too many components")),
        (F.col("equations") > eqs, "info", "MANY_EQUATIONS", F.lit("many equation blocks")),
    ]
    said = [F.when(wrong, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message"), F.when(name == "", "<unknown>").otherwise(name).alias("target_id"))) for wrong, level, code, text in rules]
    own = rows.select(F.inline(F.array_compact(F.array(*said))))
    for key, level, code, text in ((name, "warn", "DUPLICATE_IDS", "names of several records: "), (F.col("signature"), "info", "DUPLICATE_CONTENT", "signatures of several records: ")):
        n = _counted(rows, key).where("n > 0")
        own = own.unionByName(n.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.concat(F.lit(text), F.col("n").cast("string")).alias("message"), F.lit(None).cast("string").alias("target_id")))
    return own


def quality(recs: DataFrame, warn: int = 4000, most: int = 8000) -> DataFrame:
    """One row: total, kinds (a map of counts), max_estimated_len, over_warn, over_max, dupe_ids, dupe_signatures."""
    rows = stored(recs.select("kind", "fqn", estimate().alias("size"), signature().alias("signature")), "quality")  # the records are made once
    sizes = rows.groupBy("kind").agg(F.count("*").alias("n"), F.max("size").alias("largest"), F.count_if(F.col("size") > warn).alias("w"), F.count_if(F.col("size") > most).alias("m"))
    kinds = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("kind", F.lit("unknown")), "n"))))  # a row a kind
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), kinds.alias("kinds"), F.coalesce(F.max("largest"), F.lit(0)).alias("max_estimated_len"), F.coalesce(F.sum("w"), F.lit(0)).alias("over_warn"), F.coalesce(F.sum("m"), F.lit(0)).alias("over_max"))
    twice = [_counted(rows, F.coalesce("fqn", F.lit(""))).withColumnRenamed("n", "dupe_ids"), _counted(rows, F.col("signature")).withColumnRenamed("n", "dupe_signatures")]
    return out.join(twice[0]).join(twice[1])  # one row each


def splits(recs: DataFrame, limit: int = 10_000) -> DataFrame:
    """One row on a set's code: records, smallest, largest and mean size (rounded down), over (above limit), and
    dupe_ids, the ids that stand twice or more."""
    n = F.length("code_text")
    rows = stored(recs.select("id", n.alias("n")), "sizes")  # the records are made once
    out = rows.agg(F.count("*").alias("records"), F.min("n").cast("long").alias("smallest"), F.max("n").cast("long").alias("largest"), F.floor(F.sum("n") / F.count("*")).cast("long").alias("mean"), F.count_if(F.col("n") > limit).alias("over"))
    return out.join(_counted(rows, F.col("id")).withColumnRenamed("n", "dupe_ids"))


def file_report(lines: DataFrame, raw: str, most: int = 10) -> DataFrame:
    """One row on the JSON lines of a file of records: lines (blank ones aside), errors (lines that are no JSON), longest and
    mean code (rounded down), kinds (a map of counts), packages (the most frequent, by count and name) and dupe_ids."""
    v = whole_json(F.col(raw))
    get = lambda k, kind="string": F.try_variant_get("_v", f"$.collections.ast_record.{k}", kind)
    held = lines.where(F.trim(raw) != "").withColumn("_v", v)
    rows = stored(held.select(F.col("_v").isNull().alias("bad"), get("id").alias("id"), F.coalesce(get("kind"), F.lit("unknown")).alias("kind"), F.array_join(get("package_path", "array<string>"), ".").alias("package"), F.coalesce(F.length(get("code_text")), F.lit(0)).alias("n")), "lines")  # the lines are read once
    fine = rows.where(~F.col("bad"))
    out = rows.agg(F.count("*").alias("lines"), F.count_if("bad").alias("errors"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("longest"), F.coalesce(F.floor(F.sum(F.when(~F.col("bad"), F.col("n"))) / F.nullif(F.count_if(~F.col("bad")), F.lit(0))), F.lit(0)).cast("long").alias("mean"))
    kinds = fine.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))  # a row a kind
    top = fine.where("package <> ''").groupBy("package").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package").limit(most)
    top = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "package", "n"))), lambda x: F.struct(x["package"].alias("package"), x["n"].alias("n"))).alias("packages"))
    return out.join(kinds).join(top).join(_counted(fine.where("id is not null"), F.col("id")).withColumnRenamed("n", "dupe_ids"))  # one row each


def packages(recs: DataFrame) -> DataFrame:
    """(package, kinds, children, first): of each package the counts of its records by kind and of the records in packages
    below by name, the most first, and its first ten records. Counts are made before anything is put into a row."""
    path = F.array_join("package_path", ".")
    recs = stored(recs.select("package_path", "kind", "fqn"), "packages")  # the records are made once
    of = recs.select(path.alias("package"), "kind", "fqn").where("package <> ''")
    kinds = of.groupBy("package", "kind").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("package").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind", "n"))).alias("k"))
    first = _least(of, "package", "fqn", 10)
    up = recs.select(F.posexplode(F.col("package_path")).alias("at", "child"), "package_path").where("at > 0")
    below = up.groupBy(F.array_join(F.expr("slice(package_path, 1, at)"), ".").alias("package"), "child").agg(F.count("*").alias("n"))
    below = _least(below.withColumn("s", F.struct((-F.col("n")).alias("o"), "child", "n")), "package", "s", 10)
    show = lambda c, name: F.transform(c, lambda x: F.struct(x[name].alias("name"), x["n"].alias("n")))
    out = kinds.join(first, "package").join(below.withColumnRenamed("least", "below"), "package", "left")
    return out.select("package", show("k", "kind").alias("kinds"), F.coalesce(show("below", "child"), F.array().cast("array<struct<name:string,n:long>>")).alias("children"), F.col("least").alias("first"))


def _least(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """(by, least): the k smallest values of each group; what a task can't need goes before the shuffle."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(value))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("least"))
