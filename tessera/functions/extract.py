"""Extraction from model code and documentation, as built-in expressions; only the bracket scanner is an Arrow UDF."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import text as X

# Word lists, tables and patterns that results depend on.
KEYWORDS = [
    "modelica", "component", "connector", "model", "class", "package", "equation", "algorithm", "function", "parameter", "variable",
    "extends", "import", "annotation", "derivative", "integral", "matrix", "vector", "differential",
]
FORMULA_SIGNS = "∫∑∂√≥≤±≈≠∞αβγδθλμπσφψω"
SI_UNITS = {
    "SI.Voltage": ("V", "ElectricPotential"), "SI.Current": ("A", "ElectricCurrent"), "SI.Resistance": ("Ohm", "ElectricResistance"), "SI.Power": ("W", "Power"),
    "SI.Energy": ("J", "Energy"), "SI.Force": ("N", "Force"), "SI.Torque": ("N.m", "Torque"), "SI.Temperature": ("K", "ThermodynamicTemperature"),
    "SI.Pressure": ("Pa", "Pressure"), "SI.Density": ("kg/m3", "Density"), "SI.Velocity": ("m/s", "Velocity"), "SI.Acceleration": ("m/s2", "Acceleration"),
    "SI.Length": ("m", "Length"), "SI.Mass": ("kg", "Mass"), "SI.Time": ("s", "Time"), "SI.Frequency": ("Hz", "Frequency"), "SI.AngularVelocity": ("rad/s", "AngularVelocity"),
}
BUILTINS = ["exp", "sin", "cos", "log", "sqrt", "abs", "max", "min", "sum", "zeros", "identity", "fill", "size", "scalar", "transpose", "matrix"]
RESERVED = ["if", "then", "else", "elseif", "end", "for", "while", "loop", "algorithm", "in", "and", "or"]
NOT_TYPES = ["if", "then", "else", "elseif", "end", "for", "while", "loop", "when", "equation", "algorithm", "model", "package", "function", "block", "class", "record", "connector", "type", "import", "extends", "connect", "within", "annotation", "public", "protected", "return", "partial", "encapsulated"]
DOCUMENT_TYPES = [("manual", ["manual", "guide", "handbook"]), ("technical_paper", ["paper", "journal", "conference"]), ("reference", ["api", "reference", "doc"]), ("modelica_document", ["modelica"])]
NAME_DOMAINS = [
    ("thermal", ["heat", "thermal", "temperature", "convect"]), ("electrical", ["electric", "electrical", "voltage", "current", "resistor", "capacitor"]),
    ("mechanical", ["rotational", "mechanical", "torque", "force", "motion", "backlash", "spring", "damper"]), ("fluid", ["fluid", "hydraulic", "pneumatic", "flow"]),
]
PACKAGE_DOMAINS = [("thermal", ["thermal"]), ("electrical", ["electrical"]), ("mechanical", ["rotational", "translational"]), ("fluid", ["fluid"])]
PHENOMENA = [
    ("mechanical", ["spring", "elastic"], "elasticity", "hookes_law"), ("mechanical", ["damper", "friction"], "damping", "viscous_damping"), ("mechanical", ["backlash"], "backlash", "nonlinear_contact"),
    ("thermal", ["convect"], "convection", "heat_convection"), ("thermal", ["conduct"], "conduction", "heat_conduction"), ("electrical", ["resistor", "resistance"], "resistance", "ohms_law"),
]
CLASS_KINDS = ["package", "model", "class", "function", "block", "connector", "record", "type", "enumeration", "partial package", "partial model", "partial class", "partial function", "partial block", "partial connector"]
PORTS = [("RealInput", "RealInput"), ("RealOutput", "RealOutput"), ("BooleanInput", "BooleanInput"), ("BooleanOutput", "BooleanOutput"), ("IntegerInput", "IntegerInput"), ("IntegerOutput", "IntegerOutput"),
         ("HeatPort_[ab]", "HeatPort"), ("FluidPort_[ab]", "FluidPort"), ("ElectricalPin", "ElectricalPin"), ("PositivePin", "ElectricalPin"), ("NegativePin", "ElectricalPin"), ("Pin", "ElectricalPin"), ("Flange_[ab]", "MechanicalFlange")]
UNITS = "k?m|cm|mm|kg|g|s|ms|Hz|kHz|MHz|GHz|Pa|kPa|MPa|bar|°C|C|K|m/s|N|J|W|kW|MW"
STOP = ["the", "and", "for", "with", "this", "that", "what", "when", "where", "make", "create", "design", "model"]
TAILS = {"code": "model function equation parameter variable component system", "text": "technical specification component system process method"}
NAME = r"[A-Za-z_]\w*"
#: A list in round brackets, with brackets in it but none in these.
LIST = r"\((?:[^()]++|\([^()]*+\))*+\)"


def bound(value: Column, body) -> Column:
    """body of the value, which is computed once however often body uses it, also in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df: DataFrame, keep: list[str], found: Column, always: str) -> DataFrame:
    """The structs of an array, each a row beside keep; always: a field that is null in none. This is the outer form
    without its empty rows: before the plain one Spark puts filters, which compute the array again."""
    return df.select(*keep, F.inline_outer(found)).where(F.col(always).isNotNull())


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _first(text: Column, rules: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    out = otherwise
    for label, words in reversed(rules):
        out = F.when(_has(text, words), label).otherwise(out)
    return out


def document_type(name: Column) -> Column:
    """By the words of a file's name, in their order; general where none is there."""
    return _first(F.lower(name), DOCUMENT_TYPES, F.lit("general"))


def physical_domain(name: Column, package: Column) -> Column:
    """By the words of a name; a package's words come before them. Null where nothing tells."""
    return _first(F.lower(F.coalesce(package, F.lit(""))), PACKAGE_DOMAINS, _first(F.lower(name), NAME_DOMAINS, F.lit(None).cast("string")))


def phenomenon(name: Column, domain: Column) -> Column:
    """(phenomenon, physical_law) that a name suggests in its domain, else null."""
    out = F.lit(None).cast("struct<phenomenon:string,physical_law:string>")
    for where, words, what, law in reversed(PHENOMENA):
        out = F.when((domain == where) & _has(F.lower(name), words), F.struct(F.lit(what).alias("phenomenon"), F.lit(law).alias("physical_law"))).otherwise(out)
    return out


def keywords(text: Column) -> Column:
    """The keywords that stand anywhere in the text."""
    return bound(F.lower(text), lambda low: F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k)))


def has_formula(text: Column) -> Column:
    """Display or inline TeX, or one of the signs without a letter or digit beside it."""
    return text.rlike(r"(?s)(?<!\\)\$.*?(?<!\\)\$|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)") | text.rlike(rf"(?<![\p{{L}}\p{{N}}_])[{FORMULA_SIGNS}](?![\p{{L}}\p{{N}}_])")


def chunk_kind(text: Column) -> Column:
    """Code before formula before table before text."""
    return F.when(X.has_code(text), "code").when(has_formula(text), "formula").when(X.has_table(text), "table").otherwise("text")


def without_annotations(text: str | None) -> str:
    """Model code without annotations, graphics and placements; brackets are matched, as they nest."""
    text = text or ""
    out, at = [], 0
    for m in re.finditer(r"annotation\s*\(", text):
        if m.start() < at:
            continue
        depth, k = 0, m.end() - 1
        while k < len(text):
            depth += (text[k] == "(") - (text[k] == ")")
            k += 1
            if not depth:
                break
        out.append(text[at : m.start()])
        tail = re.compile(r"\s*;?").match(text, k)
        at = tail.end()
    out.append(text[at:])
    said = "".join(out)
    inner = r"\s*\([^(]*(?:\([^)]*\)[^(]*)*\)\s*,?\s*graphics\s*=\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
    said = re.sub(rf"\b(?:Icon|Diagram){inner}", "", said)
    return re.sub(r"(?:Placement|transformation|coordinateSystem)\s*\([^)]*\)", "", said)


@F.pandas_udf(T.StringType())
def annotations_removed(text: pd.Series) -> pd.Series:
    return text.map(without_annotations)


def unit_of(comment: Column) -> Column:
    """The unit in square brackets of a comment, null without one."""
    got = F.regexp_extract(comment, r"\[([^\]]+)\]", 1)
    return F.when(got != "", got)


def padded(text: Column, least: int = 50, on_new_line: bool = False) -> Column:
    """The text with blanks up to a length; with on_new_line a line end and then as many blanks as are missing."""
    n = F.length(text)
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(least) - n, F.lit(0)))
    return F.when(n >= least, text).otherwise(F.concat(text, F.lit("\n"), blanks) if on_new_line else F.concat(text, blanks))


def without_functions(code: Column) -> Column:
    """Code with every function, from its header to its own end, replaced by a comment."""
    return F.regexp_replace(code, rf"(?ms)^\s*function\s+({NAME})\b.*?end\s+\1\s*;", "// function extracted\n")


def code_block(text: Column, mode: str = "model") -> Column:
    """The first definition of a reply. instance: the first model. Else block before class before model before function,
    each in the strict form (on lines of its own) before the loose one; null without any."""
    loose = lambda k: F.regexp_extract(text, rf"(?s){k}\s+(\w+).*?end\s+\1;", 0)
    found = []
    for kind in ["model"] if mode == "instance" else ["block", "class", "model", "function"]:
        if mode != "instance":
            strict = rf"(?ms)^\s*{kind}\s+(\w+)\b\s*(.*?)\bend\s+\1\s*;$"
            name = F.regexp_extract(text, strict, 1)
            found.append(F.when(name != "", F.concat(F.lit(f"{kind} "), name, F.lit("\n "), F.regexp_extract(text, strict, 2), F.lit("end "), name, F.lit(";"))))
        found.append(F.when(loose(kind) != "", loose(kind)))
    return F.coalesce(*found)


def class_kind(code: Column) -> Column:
    """The kind of the last class that a text ends, by the first line with its name that a kind's pattern fits; else unknown."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(code, F.lit(r"(?m)^\s*end\s+([a-zA-Z0-9_]+)\s*;"), 1)), -1)

    def kind_of(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in reversed(CLASS_KINDS):
            out = F.when(line.rlike(r"^\s*" + kind.replace(" ", r"\s+") + r"\b"), kind).otherwise(out)
        return out

    def found(ended: Column) -> Column:
        kinds = F.array_compact(F.transform(F.filter(F.split(code, "\n"), lambda line: F.contains(line, ended)), kind_of))
        return F.when(ended == "", "unknown").otherwise(F.coalesce(F.get(kinds, F.lit(0)), F.lit("unknown")))

    return bound(last, found)


def matches(text: Column, pattern: str, **groups: int) -> Column:
    """All matches of a pattern as an array of structs, a field for each named group number; missing groups are empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), g).alias(n) for n, g in groups.items()])


def connections(code: Column) -> Column:
    found = matches(code, r"connect\s*\(\s*([^,]+?)\s*,\s*([^)]+?)\s*\)", from_connector=1, to_connector=2)
    return F.transform(found, lambda c: F.struct(F.trim(c["from_connector"]).alias("from_connector"), F.trim(c["to_connector"]).alias("to_connector")))


def parameters(code: Column) -> Column:
    """(name, type, default, description) of parameter, constant and final parameter declarations."""
    found = matches(code, rf'\b(?:parameter|constant)\s+([A-Za-z_][\w.]*(?:\[[^\]]*\])?)\s+({NAME})\s*({LIST})?\s*(?:=\s*([^;"]+))?\s*(?:"([^"]*)")?\s*;', type=1, name=2, attributes=3, default=4, description=5)
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.transform(found, lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), F.trim(p["default"]).alias("default"), said(p["description"]).alias("description"), attribute(p["attributes"], "unit").alias("unit"), attribute(p["attributes"], "min").alias("min"), attribute(p["attributes"], "max").alias("max")))


def attribute(attributes: Column, name: str) -> Column:
    """The value of name=value in a list of attributes, without quotes; null without it."""
    got = F.regexp_extract(attributes, rf'\b{name}\s*=\s*(?:"([^"]*)"|([^,)"]+))', 0)
    return F.when(got != "", F.regexp_replace(F.trim(F.regexp_replace(got, rf"^{name}\s*=\s*", "")), '^"|"$', ""))


def components(code: Column) -> Column:
    """(name, type, prefixes, modifications, comment) of component declarations that are no parameters; a declaration of
    several names gives a row for each."""
    prefix = r"(?:input|output|flow|stream|discrete|parameter|constant|final|inner|outer|replaceable|redeclare)\s+"
    found = matches(code, rf"(?m)^\s*((?:{prefix})*)([A-Za-z_][\w.]*(?:\s*\[[^\]]*\])?)\s+([A-Za-z_][^;=]*?(?:=[^;]*)?)\s*;", prefixes=1, type=2, names=3)
    fit = F.filter(found, lambda c: ~F.contains(c["prefixes"], F.lit("parameter")) & ~F.lower(c["type"]).isin(NOT_TYPES))
    each = F.transform(fit, lambda c: F.transform(
        matches(c["names"], rf'({NAME})(\s*\[[^\]]*\])?\s*(\((?:[^()]|\([^()]*\))*\))?\s*(?:=[^,]*)?\s*(?:"([^"]*)")?\s*(?:,|$)', name=1, dims=2, modifications=3, comment=4),
        lambda n: F.struct(n["name"].alias("name"), c["type"].alias("type"), X.words(c["prefixes"]).alias("prefixes"), n["modifications"].alias("modifications"), F.trim(n["dims"]).alias("array_dims"), F.when(n["comment"] != "", n["comment"]).alias("comment"))))
    return F.flatten(each)


def variables(code: Column) -> Column:
    """(name, type, prefixes, unit, quantity, binding, comment, attributes) of variable declarations, the first of each name."""
    prefix = r"(?:input|output|flow|stream|discrete|final|inner|outer|protected)\s+"
    found = matches(code, rf'(?m)^\s*((?:{prefix})*)([A-Za-z_][\w.]*)\s+({NAME})(?!\s*=\s*if\b)(\s*\[[^\]]*\])?\s*({LIST})?\s*(?:=\s*([^;"]+?))?\s*(?:"([^"]*)")?\s*;', prefixes=1, type=2, name=3, attributes=5, binding=6, comment=7)
    fit = F.filter(found, lambda v: ~F.lower(v["type"]).isin([*NOT_TYPES, "parameter", "constant"]) & ~F.lower(v["name"]).isin([*NOT_TYPES, *RESERVED]))
    first = bound(fit, lambda vs: bound(F.transform(vs, lambda v: v["name"]), lambda names: F.filter(vs, lambda v, k: F.array_position(names, v["name"]) == k + 1)))
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.transform(first, lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"), X.words(v["prefixes"]).alias("prefixes"), attribute(v["attributes"], "unit").alias("unit"), attribute(v["attributes"], "quantity").alias("quantity"), some(v["binding"]).alias("binding"), some(v["comment"]).alias("comment"), v["attributes"].alias("attributes")))


def quantities(code: Column) -> Column:
    """(name, unit, quantity, display_unit, nominal) of variables: by their attributes, else by their SI type, else by a unit
    in the comment."""
    units = F.create_map(*[F.lit(x) for t, (u, _) in SI_UNITS.items() for x in (t, u)])
    kinds = F.create_map(*[F.lit(x) for t, (_, q) in SI_UNITS.items() for x in (t, q)])
    shown = lambda v: [attribute(v["attributes"], "displayUnit").alias("display_unit"), attribute(v["attributes"], "nominal").alias("nominal")]
    told = F.transform(variables(code), lambda v: F.when(v["unit"].isNotNull() | v["quantity"].isNotNull(), F.struct(v["name"].alias("name"), v["unit"].alias("unit"), v["quantity"].alias("quantity"), *shown(v))).otherwise(
        F.struct(v["name"].alias("name"), F.coalesce(F.try_element_at(units, v["type"]), unit_of(v["comment"])).alias("unit"), F.try_element_at(kinds, v["type"]).alias("quantity"), *shown(v))))
    return F.filter(told, lambda q: q["unit"].isNotNull() | q["quantity"].isNotNull())


def names_only(tokens: Column) -> Column:
    """The tokens that are names, with or without dots, and no reserved words."""
    return F.filter(tokens, lambda t: ~t.isin(RESERVED) & t.rlike(r"(?U)^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"))


def dependencies(code: Column) -> Column:
    """Sorted distinct packages: imports, and what stands before the last name of a qualified reference that is no built-in."""
    imports = F.regexp_extract_all(code, F.lit(r"import\s+([A-Za-z_][\w.]*)"), 1)
    names = F.filter(F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][\w.]*\.[A-Za-z_]\w*)"), 1), lambda q: ~F.element_at(F.split(q, r"\."), -1).isin(BUILTINS))
    return F.array_sort(F.array_distinct(F.concat(imports, F.transform(names, lambda q: F.regexp_extract(q, r"^(.*)\.[^.]*$", 1)))))


def interfaces(code: Column) -> Column:
    """(name, type, subtype, direction, description) of control and physical ports, port kinds in their fixed order."""
    found = []
    for pattern, subtype in PORTS:
        control = subtype.endswith(("Input", "Output"))
        way = ("input" if subtype.endswith("Input") else "output") if control else "bidirectional"
        some = matches(code, rf'(?:\w+\.)*\b{pattern}\s+(\w+)(?:\([^)]*\))?\s*(?:"([^"]*)")?', name=1, description=2)
        ports = F.transform(some, _port("control" if control else "physical", subtype, way))
        found.append(F.when(F.contains(code, F.lit(pattern.split("[")[0])), ports).when(code.isNotNull(), F.array().cast(PORT)))  # most texts hold few kinds
    return F.concat(*found)


PORT = "array<struct<name:string,type:string,subtype:string,direction:string,description:string>>"


def _port(kind: str, subtype: str, way: str):
    return lambda p: F.struct(p["name"].alias("name"), F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"), F.lit(way).alias("direction"), F.when(p["description"] != "", p["description"]).alias("description"))


def documentation(code: Column) -> Column:
    """The text of Documentation(info="..."), without tags and entities; null up to ten characters."""
    html = F.regexp_extract(code, r'(?s)Documentation\s*\(\s*info\s*=\s*"(.*?)"(?:\s*,|\s*\))', 1)
    out = html_text(html)
    return F.when(F.length(out) > 10, out)


def html_text(html: Column) -> Column:
    """Blanks for br, line ends for p, no other tags, four entities in the order lt gt amp quot, single blanks."""
    out = F.regexp_replace(html, r"<br\s*/?>", " ")
    out = F.regexp_replace(out, r"<p[^>]*>|</p>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    return X.stripped(F.regexp_replace(out, r"\s+", " "))


def leading_comment(code: Column) -> Column:
    """The block of // comment lines right above the first definition."""
    got = F.regexp_extract(code, r"(?m)((?:^[ \t]*//[^\n]*\n)+)[ \t\n]*(?:within|partial|package|model|block|function|class|record|connector|type)\b", 1)
    return X.stripped(got)


def terms(text: Column, limit: int = 12) -> Column:
    """Technical words: acronyms, identifiers, numbers with a unit and capitalised words, in this order; without stop
    words, each once whatever its case, the first ``limit``."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 0) for p in (r"\b[A-Z]{2,}\b", r"\b[a-zA-Z_][a-zA-Z0-9_]{3,}\b", rf"\b\d+(?:\.\d+)?\s?(?:{UNITS})\b", r"\b[A-Z][a-z]{3,}\b")])
    fit = F.filter(found, lambda t: ~F.lower(t).isin(STOP))

    def first(ts: Column) -> Column:
        low = F.transform(ts, lambda t: F.lower(t))
        return bound(low, lambda ls: F.transform(F.slice(F.array_distinct(ls), 1, limit), lambda t: F.element_at(ts, F.array_position(ls, t).cast("int"))))

    return bound(fit, first)


def expanded_query(query: Column, focus: str = "functions") -> Column:
    """Short queries, of under 20 words of two characters or more, with a tail of words for the focus; of longer ones
    their first half, 15 words at least."""
    ws = F.filter(X.words(F.regexp_replace(query, "[/,]", " ")), lambda w: F.length(w) > 1)
    tail = TAILS["code" if focus in ("packages", "functions", "equations") else "text"]
    n = F.size(ws)
    return F.when(n < 20, F.trim(F.concat(F.array_join(ws, " "), F.lit(" " + tail)))).otherwise(F.array_join(F.slice(ws, F.lit(1), F.greatest(F.lit(15), F.floor(n / 2).cast("int"))), " "))


def enriched(queries: Column, extra: Column) -> Column:
    """Each query with one of the extra terms in turn, unless it holds that already."""
    def each(terms: Column) -> Column:
        take = lambda k: F.get(terms, F.pmod(k, F.greatest(F.size(terms), F.lit(1))))
        return F.transform(queries, lambda q, k: F.when(F.coalesce(~F.contains(F.lower(q), F.lower(take(k))), F.lit(False)), F.concat(q, F.lit(" "), take(k))).otherwise(q))

    return bound(extra, each)


def normalised_path(path: Column) -> Column:
    return F.trim(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))


SPANS = r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$"


def math_spans(text: Column) -> Column:
    """All TeX spans, of any length: display and inline."""
    return F.regexp_extract_all(text, F.lit(SPANS), 0)


def stashed(text: Column) -> Column:
    """(text, spans): TeX spans replaced by numbered marks. As spans don't overlap, the text is cut at them and joined."""
    spans = math_spans(text)
    parts = F.split(text, SPANS, -1)
    marks = F.concat(F.transform(spans, lambda s, k: F.concat(F.lit("\x02"), k.cast("string"), F.lit("\x03"))), F.array(F.lit("")))
    return F.struct(F.array_join(F.zip_with(parts, marks, lambda p, m: F.concat(p, m)), "").alias("text"), spans.alias("spans"))


def restored(text: Column, spans: Column) -> Column:
    """The text of ``stashed`` with the spans in their places again."""
    parts = F.split(text, "\x02\\d+\x03", -1)
    held = F.transform(F.regexp_extract_all(text, F.lit("\x02(\\d+)\x03"), 1), lambda k: F.get(spans, k.cast("int")))
    return F.array_join(F.zip_with(parts, F.concat(held, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
