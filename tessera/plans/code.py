"""Extraction from model code: declarations, connections, units, interfaces, documentation, symbols and kinds.

The code is written from the table part: a package of one model for each part, with its name, size and type in it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import extract as E
from tessera.operators.scanners import nested_split, symbols
from tessera.plans.registry import query
from tessera.session import spread

TEMPLATE = """within Lib.<brand>;
// made of <type>
// part <key>
model M<key> "<name>"
  extends Base.Part;
  import Modelica.Constants.pi;
  parameter Real mass(unit="kg", min=0) = <size> "total mass";
  parameter SI.Length size = <size>;
  constant Real g = 9.81 "gravity";
  Modelica.Blocks.Interfaces.RealInput u "signal";
  input Real w "speed [rad/s]";
  SI.Voltage v "drop";
  Real x(unit="m", start=1) = <size> "way";
  Resistor R<size>(R=100, f(a=1)), C1 "store";
  HeatPort_a port;
  function f<key>
    output Real y;
  end f<key>;
equation
  connect(R<size>.p, C1.n);
  connect( port , R<size>.heat[1] );
  der(x) = Utilities.clip(w * pi);
  annotation(Documentation(info="<p>Part &lt;<name>&gt;<br/> of   size <size></p>"), Icon(graphics={Line(points={{0,0},{1,1}})}));
end M<key>;"""
COLUMNS = {"key": ("p_partkey", True), "brand": ("replace(p_brand, '#', '')", False), "type": ("p_type", False), "name": ("p_name", False), "size": ("p_size", True)}


def built(text: str) -> tuple[str, str]:
    """(DuckDB SQL, Spark SQL) of a template over part."""
    duck, spark = [], []
    at = 0
    while at < len(text):
        opened = next((k for k in range(at, len(text)) if text[k] == "<" and text[k + 1 :].split(">")[0] in COLUMNS), len(text))
        if opened > at:
            said = text[at:opened].replace("'", "''")
            duck.append("'" + said.replace("\n", "' || chr(10) || '") + "'")
            spark.append("'" + said.replace("\\", "\\\\").replace("''", "\\'").replace("\n", "\\n") + "'")
        if opened < len(text):
            name = text[opened + 1 :].split(">")[0]
            column, number = COLUMNS[name]
            duck.append(column)
            spark.append(f"cast({column} AS string)" if number else column)
            at = opened + len(name) + 2
        else:
            at = opened
    return " || ".join(duck), f"concat({', '.join(spark)})"


DUCK, SPARK = built(TEMPLATE)
CODE = f"WITH c AS (SELECT p_partkey, p_size, {DUCK} AS code FROM part) "


def code(t):
    return spread(t.part).select("p_partkey", "p_size", "p_name", F.expr(SPARK).alias("code"))


@query(CODE + r"""SELECT p_partkey, unnest(regexp_extract_all(code, 'connect\(\s*([^,]+?)\s*,\s*([^)]+?)\s*\)', 1)) AS a, unnest(regexp_extract_all(code, 'connect\(\s*([^,]+?)\s*,\s*([^)]+?)\s*\)', 2)) AS b FROM c""")
def extract_connections(t):
    return code(t).select("p_partkey", F.inline(E.connections(F.col("code"))).alias("a", "b"))


PARAMETER = r'\b(?:parameter|constant)\s+([A-Za-z_][\w.]*)\s+([A-Za-z_]\w*)\s*(\([^)]*\))?\s*(?:=\s*([^;"]+))?\s*(?:"([^"]*)")?\s*;'


@query(CODE + f"""SELECT p_partkey, t AS type, n AS name, trim(d) AS "default", nullif(regexp_extract(a, 'unit="([^"]*)"', 1), '') AS unit, nullif(s, '') AS description FROM (SELECT p_partkey, {", ".join(f"unnest(regexp_extract_all(code, '{PARAMETER}', {k})) AS {x}" for k, x in enumerate("tnads", 1))} FROM c)""")
def extract_parameters(t):
    rows = E.rows_of(code(t), ["p_partkey"], E.parameters(F.col("code")), "name")
    return rows.select("p_partkey", "type", "name", "default", "unit", "description")


@query(CODE + r"""SELECT p_partkey, unnest(list_sort(list_distinct(list_concat(regexp_extract_all(code, 'import\s+([A-Za-z_][\w.]*)', 1), list_transform(list_filter(regexp_extract_all(code, '\b([A-Za-z_][\w.]*\.[A-Za-z_]\w*)', 1), lambda q: NOT list_contains(['exp', 'sin', 'cos', 'log', 'sqrt', 'abs', 'max', 'min', 'sum', 'zeros', 'identity', 'fill', 'size', 'scalar', 'transpose', 'matrix'], regexp_extract(q, '([^.]*)$', 1))), lambda q: regexp_replace(q, '\.[^.]*$', '')))))) AS package FROM c""")
def extract_dependencies(t):
    return code(t).select("p_partkey", F.explode(E.dependencies(F.col("code"))).alias("package"))


@query()
def extract_components(t):
    return E.rows_of(code(t).withColumn("code", E.annotations_removed("code")), ["p_partkey"], E.components(F.col("code")), "name")


@query()
def extract_variables(t):
    return E.rows_of(code(t).withColumn("code", E.annotations_removed("code")), ["p_partkey"], E.variables(F.col("code")), "name")


@query()
def extract_quantities(t):
    """Units and quantities of variables: by attribute, by SI type, by a unit in the comment."""
    return E.rows_of(code(t), ["p_partkey"], E.quantities(F.col("code")), "name")


@query()
def extract_interfaces(t):
    return E.rows_of(code(t), ["p_partkey"], E.interfaces(F.col("code")), "name")


@query()
def remove_annotations(t):
    return code(t).select("p_partkey", E.annotations_removed("code").alias("code"))


@query(CODE + r"SELECT p_partkey, regexp_replace(regexp_replace(code, '(?m)^  function f', '  function f'), '(?ms)^\s*function\s+([A-Za-z_]\w*)\b.*?end\s+f\d+\s*;', '// function extracted' || chr(10)) AS code FROM c")
def remove_functions(t):
    return code(t).select("p_partkey", E.without_functions(F.col("code")).alias("code"))


@query(CODE + r"""SELECT p_partkey, regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(code, '(?s)info="(.*?)"\)', 1), '<br\s*/?>', ' ', 'g'), '<p[^>]*>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g').trim() AS info FROM c""")
def extract_documentation(t):
    return code(t).select("p_partkey", E.documentation(F.col("code")).alias("info"))


@query(CODE + r"SELECT p_partkey, regexp_replace(regexp_extract(code, '(?m)((?:^//[^\n]*\n)+)', 1), '\s+$', '') AS comment FROM c")
def leading_comments(t):
    return code(t).select("p_partkey", E.leading_comment(F.col("code")).alias("comment"))


@query("SELECT p_partkey, nullif(regexp_extract(c, '\\[([^\\]]+)\\]', 1), '') AS unit FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' [' || p_type || '] x' END AS c FROM part)")
def unit_from_comment(t):
    c = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ["), "p_type", F.lit("] x")))
    return t.part.select("p_partkey", E.unit_of(c).alias("unit"))


@query(CODE + "SELECT p_partkey, 'Lib.' || regexp_extract(code, 'within Lib\\.(\\w+)', 1) || '.M' || p_partkey AS fqn, 'model' AS kind, 4::BIGINT AS first_line, len(string_split(code, chr(10)))::BIGINT AS last_line FROM c "
       "UNION ALL SELECT p_partkey, 'Lib.' || regexp_extract(code, 'within Lib\\.(\\w+)', 1) || '.M' || p_partkey || '.f' || p_partkey, 'function', list_position(list_transform(string_split(code, chr(10)), lambda x: trim(x)), 'function f' || p_partkey)::BIGINT, list_position(list_transform(string_split(code, chr(10)), lambda x: trim(x)), 'end f' || p_partkey || ';')::BIGINT FROM c")
def extract_symbols(t):
    """Definitions with qualified names and lines, by headers and their ends."""
    s = code(t).select("p_partkey", F.explode(symbols("code")).alias("s"))
    return s.select("p_partkey", "s.fqn", "s.kind", F.col("s.first_line").cast("long").alias("first_line"), F.col("s.last_line").cast("long").alias("last_line"))


@query()
def nested_split_args(t):
    """Declarations between commas outside of brackets and quotes."""
    src = F.concat(F.col("p_name"), F.lit("(x=1,y="), F.col("p_size").cast("string"), F.lit('), b[2,3] ,, c="p,q", '), F.regexp_replace("p_type", " ", ",("), F.lit("))"))
    return t.part.select("p_partkey", F.posexplode(nested_split(src)).alias("at", "part"))


KIND = """CASE p_size % 5 WHEN 0 THEN 'partial model' WHEN 1 THEN 'package' WHEN 2 THEN 'function' WHEN 3 THEN 'connector' ELSE 'enumeration' END"""


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size % 5 = 0 THEN 'partial model' ELSE {KIND} END AS kind FROM part) GROUP BY 1")
def classify_histogram(t):
    """Kinds of code samples, by the line of the last class that ends."""
    kind = F.expr(KIND)
    text = F.when(F.col("p_size") % 7 == 0, F.lit("nothing here")).otherwise(F.concat(F.lit("model Other\nend Other;\n "), kind, F.lit(" A_"), F.col("p_partkey").cast("string"), F.lit("\n  x;\nend A_"), F.col("p_partkey").cast("string"), F.lit(";")))
    return t.part.groupBy(E.class_kind(text).alias("kind")).agg(F.count("*").alias("n"))
