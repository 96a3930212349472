"""Records from code: the files are written from the table part, a model with a function in it for each part, with headers
and ends in comments and strings that are none."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import extract as E
from tessera.operators import records as R
from tessera.plans.code import built
from tessera.plans.registry import query
from tessera.session import spread

#: The file in pieces, so that SQL can tell a definition's own text: BEFORE, MODEL, FUNCTION, MORE, ANNOTATION, REST.
PIECES = {
    "before": 'within Lib.<brand>;\n// model Fake<key>\n/* end M<key>; package Hidden */\n',
    "model": 'model M<key> "end M<key>; function g"\n  extends Base.Part;\n  import Modelica.Constants.pi;\n  parameter Real mass(unit="kg", min=0) = <size> "total mass";\n  Real x(unit="m", start=1, fixed=true); // end M<key>;\n  Resistor R1(R=100, redeclare package Medium = Water), C1 "store";\n  ',
    "function": 'function f<key> "model in text"\n    input Real u;\n    output Real y;\n  algorithm\n    y := u * <size>; /* end f<key>; */\n  end f<key>;',
    "more": "\ninitial equation\n  x = <size>;\nequation\n  der(x) = if mass > 1 then Utilities.clip(pi) else pre(x);\n  connect(R1.p, C1.n);\n",
    "annotation": '  annotation(Documentation(info="<p>Part &lt;<name>&gt; of type <type></p>"));',
    "rest": "\nend M<key>;",
}
BUILT = {k: built(v) for k, v in PIECES.items()}
FILES = "WITH c AS (SELECT p_partkey, p_size, p_name, p_type, replace(p_brand, '#', '') AS brand, " + ", ".join(f"{sql} AS {k}_" for k, (sql, _) in BUILT.items()) + " FROM part), "
OWN = FILES + """d AS (SELECT *, 'Lib.' || brand || '.M' || p_partkey AS fqn, 'model' AS kind, 4 AS first_line, 22 AS last_line, model_ || more_ || '  ' || rest_ AS clean, model_ || more_ || annotation_ || rest_ AS own, -1 AS parent, 0 AS number FROM c
 UNION ALL SELECT *, 'Lib.' || brand || '.M' || p_partkey || '.f' || p_partkey, 'function', 10, 15, function_, function_, 0, 1 FROM c),
i AS (SELECT *, sha1(clean) AS checksum, fqn || '|' || kind || '|1.0.0|' || sha1(clean) || '|' || first_line || '-' || last_line AS id FROM d) """


def files(t, times=None):
    """The files; times, if given, gives a row for each copy of a part's file."""
    text = F.expr("concat(" + ", ".join(spark for _, spark in BUILT.values()) + ")")
    part = spread(t.part if times is None else t.part.select("*", times.alias("copy")))
    return part.select("p_partkey", F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".mo")).alias("path"), text.alias("code"))


def recs(t):
    return R.records(R.symbols(files(t), "code", ["p_partkey", "path"]), "path")


@query(OWN + "SELECT p_partkey, number, parent, kind, fqn, first_line, last_line, true AS closed, sha1(own) AS own FROM i")
def code_symbols(t):
    """Definitions by the lexer, through the table function in SQL; each with the text that is its own."""
    R.table_function(t.spark)
    rows = t.spark.sql("SELECT f.p_partkey, d.* FROM {files} f, LATERAL definitions(f.code) d", files=files(t))
    return rows.select("p_partkey", "number", "parent", "kind", F.array_join(F.concat("scope", F.array("name")), ".").alias("fqn"), "first_line", "last_line", "closed", F.sha1("own").alias("own"))


@query(OWN + """SELECT id, kind, fqn, checksum, 'part/' || p_partkey || '.mo' AS file_path, first_line AS first, CASE kind WHEN 'model' THEN 'Part <' || p_name || '> of type ' || p_type END AS info,
  CASE kind WHEN 'model' THEN 1 ELSE 0 END::BIGINT AS parameters, CASE kind WHEN 'model' THEN 3 ELSE 2 END::BIGINT AS components, CASE kind WHEN 'model' THEN 2 ELSE 1 END::BIGINT AS equations, CASE kind WHEN 'model' THEN 1 ELSE 0 END::BIGINT AS connections,
  (last_line - first_line + 1)::BIGINT AS code_lines, CASE kind WHEN 'model' THEN ['Base', 'Base.Part', 'C1', 'Modelica.Constants', 'Modelica.Constants.pi', 'R1', 'Utilities'] ELSE [] END AS uses FROM i""")
def ast_records(t):
    """Nested records of code files, flattened for comparison."""
    s = "statistics"
    return recs(t).select(
        "id", "kind", "fqn", F.col("metadata.checksum").alias("checksum"), "metadata.file_path", F.col("metadata.line_range.start").alias("first"), F.col("documentation.info").alias("info"),
        *[F.col(f"{s}.{c}_count").alias(c) for c in ("parameters", "components", "equations", "connections")], f"{s}.code_lines", F.col("neighbors.uses").alias("uses"))


@query(OWN + """, e AS (SELECT id, p_size, unnest(CASE kind WHEN 'model' THEN [{'s': 'initial_equation', 'str': 'x = ' || p_size, 'vars': ['x'], 'guards': [], 'ops': [], 'phase': 'initial'}, {'s': 'equation', 'str': 'der(x) = if mass > 1 then Utilities.clip(pi) else pre(x)', 'vars': ['Utilities.clip', 'der', 'else', 'if', 'mass', 'pi', 'pre', 'then', 'x'], 'guards': ['if'], 'ops': ['der', 'pre'], 'phase': 'runtime'},
 {'s': 'equation', 'str': 'connect(R1.p, C1.n)', 'vars': ['C1.n', 'R1.p', 'connect'], 'guards': [], 'ops': [], 'phase': 'runtime'}] ELSE [{'s': 'algorithm', 'str': 'y := u * ' || p_size, 'vars': ['u', 'y'], 'guards': [], 'ops': [], 'phase': 'runtime'}] END) AS x FROM i)
SELECT id, x.s AS section_type, x.str AS str, x.vars AS vars, x.guards AS guards, x.ops AS ops, x.phase AS phase FROM e""")
def ast_equations(t):
    """Statements of the records' sections with their names, guards, operators and phase."""
    blocks = E.rows_of(recs(t), ["id"], F.col("equations"), "section_type")
    rows = E.rows_of(blocks, ["id", "section_type"], F.col("items"), "str")
    return rows.select("id", "section_type", "str", "vars", "guards", "ops", "phase")


@query(OWN + """SELECT id, name, type, k, v FROM (SELECT id, unnest([{'name': 'x', 'type': 'Real', 'k': 'unit', 'v': 'm'}, {'name': 'x', 'type': 'Real', 'k': 'start', 'v': '1'}, {'name': 'x', 'type': 'Real', 'k': 'fixed', 'v': 'true'}, {'name': 'R1', 'type': 'Resistor', 'k': 'R', 'v': '100'},
 {'name': 'R1', 'type': 'Resistor', 'k': 'redeclare_0', 'v': 'package Medium = Water'}, {'name': 'x', 'type': 'Real', 'k': '=unit', 'v': '"m"'}, {'name': 'x', 'type': 'Real', 'k': '=start', 'v': '1'}, {'name': 'x', 'type': 'Real', 'k': '=fixed', 'v': 'true'}], recursive := true) FROM i WHERE kind = 'model')""")
def ast_attributes(t):
    """Attributes of variables, and modifications of components (those of x marked with =)."""
    one = lambda c, m, mods: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x[m].alias("m"), F.lit(mods).alias("mods")))
    both = E.rows_of(recs(t), ["id"], F.concat(one("variables", "attributes", False), one("components", "modifications", True)), "name")
    rows = both.select("id", "name", "type", "mods", F.explode("m").alias("k", "v"))
    return rows.select("id", "name", "type", F.when(F.col("mods") & (F.col("name") == "x"), F.concat(F.lit("="), "k")).otherwise(F.col("k")).alias("k"), "v")


ESTIMATE = "length(kind || name) + length(coalesce(info, '')) + CASE kind WHEN 'model' THEN 560 ELSE 280 END"
TWICE = OWN + f""", n AS (SELECT *, CASE kind WHEN 'model' THEN 'M' ELSE 'f' END || p_partkey AS name, CASE kind WHEN 'model' THEN 'Part <' || p_name || '> of type ' || p_type END AS info FROM i),
r AS (SELECT *, ({ESTIMATE})::BIGINT AS est FROM (SELECT * FROM n UNION ALL SELECT * FROM n WHERE p_size % 10 = 0))"""


def twice(t):
    """The records of all files, those of every tenth size twice."""
    again = F.explode(F.when(F.col("p_size") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return R.records(R.symbols(files(t, again), "code", ["path"]), "path")


@query(TWICE + """SELECT 'warn' AS level, 'OVERSIZE' AS code, 'estimated content ' || est || ' exceeds 610' AS message, fqn AS target_id FROM r WHERE est > 610 UNION ALL SELECT 'warn', 'MANY_COMPONENTS', 'too many components', fqn FROM r WHERE kind = 'model' UNION ALL SELECT 'info', 'MANY_EQUATIONS', 'many equation blocks', fqn FROM r WHERE kind = 'model'
UNION ALL SELECT 'warn', 'DUPLICATE_IDS', 'names of several records: ' || count(*), NULL FROM (SELECT fqn FROM r GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'info', 'DUPLICATE_CONTENT', 'signatures of several records: ' || count(*), NULL FROM (SELECT fqn FROM r GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0""")
def record_issues(t):
    """Rules that records and their set break, with limits low enough for the data."""
    return R.issues(twice(t), most=610, params=1, comps=2, eqs=1)


@query(TWICE + """, k AS (SELECT kind, count(*) AS n FROM r GROUP BY 1), g AS (SELECT count(*) AS d FROM (SELECT fqn FROM r GROUP BY 1 HAVING count(*) > 1))
SELECT k.kind AS kind, k.n AS n, (SELECT count(*) FROM r) AS total, (SELECT max(est) FROM r) AS max_estimated_len, (SELECT count(*) FROM r WHERE est > 600) AS over_warn, (SELECT count(*) FROM r WHERE est > 610) AS over_max, g.d AS dupe_ids, g.d AS dupe_signatures FROM k, g""")
def record_quality(t):
    """Counts of a set of records: by kind, the largest, those over two limits, names and signatures that repeat."""
    q = R.quality(twice(t), warn=600, most=610)
    return q.select(F.explode("kinds").alias("kind", "n"), "total", F.col("max_estimated_len").cast("long").alias("max_estimated_len"), "over_warn", "over_max", "dupe_ids", "dupe_signatures")


@query(TWICE + """, l AS (SELECT id, greatest(length(trim(clean, ' ' || chr(10))), 50) AS n FROM r)
SELECT count(*) AS records, min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest, floor(sum(n) / count(*))::BIGINT AS mean, count(*) FILTER (n > 400) AS "over", (SELECT count(*) FROM (SELECT id FROM l GROUP BY 1 HAVING count(*) > 1)) AS dupe_ids FROM l""")
def record_sizes(t):
    """Sizes of the records' code, and ids that stand twice."""
    return R.splits(twice(t), 400)


@query(TWICE + """, p AS (SELECT 'Lib.' || brand AS package, kind, fqn, NULL AS child FROM r WHERE kind = 'model' UNION ALL SELECT 'Lib.' || brand || '.M' || p_partkey, kind, fqn, NULL FROM r WHERE kind = 'function'),
b AS (SELECT package, list(child ORDER BY n DESC, child)[1:10] AS children, list(n ORDER BY n DESC, child)[1:10] AS ns FROM (SELECT 'Lib' AS package, brand AS child, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'Lib.' || brand, 'M' || p_partkey, count(*) FROM r WHERE kind = 'function' GROUP BY 1, 2) GROUP BY 1)
SELECT package, any_value(kind) AS kind, count(*) AS n, list(fqn ORDER BY fqn)[1:10] AS first, coalesce(any_value(children), []) AS children, coalesce(any_value(ns), []) AS ns FROM p LEFT JOIN b USING (package) GROUP BY 1""")
def record_packages(t):
    """Packages with their records by kind, the packages below and the first ten records."""
    p = R.packages(twice(t))
    return p.select("package", F.explode("kinds").alias("k"), "first", F.transform("children", lambda c: c["name"]).alias("children"), F.transform("children", lambda c: c["n"]).alias("ns")).select("package", "k.name", "k.n", "first", "children", "ns").withColumnRenamed("name", "kind")


LINE = {"type": "object", "required": ["start", "end"], "properties": {"start": {"type": "integer", "minimum": 1}, "end": {"type": "integer", "minimum": 16}}}
SCHEMA = {
    "type": "object", "required": ["collections", "validation_rules"], "additionalProperties": False,
    "properties": {
        "collections": {"type": "object", "properties": {"ast_record": {
            "type": "object", "required": ["id", "kind", "fqn", "parameters", "equations"],
            "properties": {
                "id": {"type": "string", "minLength": 16}, "kind": {"const": "model"}, "package_path": {"type": "array", "minItems": 1, "items": {"type": "string"}},
                "metadata": {"type": "object", "required": ["timestamp"], "properties": {"line_range": LINE}}, "parameters": {"type": "array", "minItems": 1},
                "equations": {"type": "array", "items": {"type": "object", "properties": {"items": {"type": "array", "items": {"type": "object", "properties": {"ops": {"type": "array", "items": {"enum": ["pre", "edge", "sample"]}}}}}}}},
            }}}},
        "validation_rules": {"type": "object", "properties": {"no_duplicate_id": {"type": "boolean", "const": True}, "min_equation_vars": {"type": "integer", "const": 3}}},
    },
}


@query(OWN + """SELECT id, unnest(CASE kind WHEN 'model' THEN ['collections.ast_record.metadata.timestamp:REQUIRED', 'collections.ast_record.equations[].items[].ops[]:ENUM', 'validation_rules.min_equation_vars:CONST'] ELSE ['collections.ast_record.kind:CONST', 'collections.ast_record.metadata.timestamp:REQUIRED', 'collections.ast_record.metadata.line_range.end:MINIMUM', 'collections.ast_record.parameters:MIN_ITEMS', 'validation_rules.min_equation_vars:CONST'] END) AS broken FROM i""")
def record_schema(t):
    """Lines of records as JSON, held against a JSON Schema with constants."""
    from tessera.operators.schema import schema_errors

    lines = R.entries(recs(t).withColumn("of", F.col("id")), ["of"])
    return schema_errors(lines, "json", SCHEMA, ["of"]).select(F.col("of").alias("id"), F.concat_ws(":", "path", "code").alias("broken"))


@query(TWICE + """, l AS (SELECT *, kind = 'model' AND p_partkey % 11 = 0 AS bad, CASE kind WHEN 'model' THEN 'Lib.' || brand ELSE 'Lib.' || brand || '.M' || p_partkey END AS package, greatest(length(trim(clean, ' ' || chr(10))), 50) AS len FROM r),
k AS (SELECT kind, count(*) AS n FROM l WHERE NOT bad GROUP BY 1), p AS (SELECT package, count(*) AS n FROM l WHERE NOT bad GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT k.kind AS kind, k.n AS n, (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM l WHERE bad) AS errors, (SELECT max(len) FROM l WHERE NOT bad) AS longest, (SELECT floor(sum(len) / count(*))::BIGINT FROM l WHERE NOT bad) AS mean,
  (SELECT list(package || ' ' || n ORDER BY n DESC, package) FROM p) AS packages, (SELECT count(*) FROM (SELECT id FROM l WHERE NOT bad GROUP BY 1 HAVING count(*) > 1)) AS dupe_ids FROM k""")
def record_file_report(t):
    """A report on the JSON lines of records, of which some are cut off."""
    lines = R.entries(twice(t).withColumn("at", F.regexp_extract("metadata.file_path", r"(\d+)", 1).cast("long")).withColumn("what", F.col("kind")), ["at", "what"])
    cut = (F.col("what") == "model") & (F.col("at") % 11 == 0)
    said = lines.select(F.when(cut, F.expr("substring(json, 1, length(json) - 1)")).otherwise(F.col("json")).alias("line"))
    r = R.file_report(said.unionByName(t.region.select(F.lit(" ").alias("line"))), "line")
    return r.select(F.explode("kinds").alias("kind", "n"), "lines", "errors", "longest", "mean", F.transform("packages", lambda p: F.concat(p["package"], F.lit(" "), p["n"].cast("string"))).alias("packages"), "dupe_ids")
