"""Chunkers and extraction against brute force on small fixtures."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.functions import extract as E
from tessera.operators import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_packed_lines():
    r = random.Random(3)
    for _ in range(60):
        text = "\n".join("x" * r.choice([0, 3, 20, 45]) for _ in range(r.randint(1, 30)))
        parts = C.packed_lines(text, 5, 40, 60)
        if len(text) <= 60:
            assert parts == ([{"first_line": 5, "last_line": 5 + max(len(text.splitlines()), 1) - 1, "text": text}] if text else [])
            continue
        lines = text.splitlines()
        for p in parts:
            assert p["text"] == "\n".join(lines[p["first_line"] - 5 : p["last_line"] - 4]).rstrip("\n") and p["text"]
            assert len(p["text"]) <= 40 or "\n" not in p["text"].strip("\n")
        assert "".join(p["text"] for p in parts).replace("\n", "") == text.replace("\n", "")
    assert C.packed_lines(None, 1, 5, 9) == [] and C.packed_lines("", 1, 5, 9) == []


def test_split_at_ends():
    lines = ["a" * 9] * 12
    text = "\n".join(lines)
    cut = lambda ends: [(p["first_line"], p["last_line"]) for p in C.split_at_ends(text, 1, ends, 30, 50)]
    assert cut([2, 6]) == [(1, 2), (3, 6), (7, 11), (12, 12)]  # the last end at the soft limit, else the hard limit
    assert cut([12]) == [(1, 5), (6, 10), (11, 12)]
    assert cut([]) == [(1, 3), (4, 6), (7, 9), (10, 12)]  # without ends the lines are packed to the soft limit
    assert C.split_at_ends("short", 4, [4], 30, 50) == [{"first_line": 4, "last_line": 4, "text": "short"}]
    assert C.split_at_ends(None, 1, [1], 30, 50) == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "aaa\nbbb\nccc", [2]), (2, None, None), (3, "", [])], "id int, t string, e array<int>")
    got = {r.id: [(p.part, p.first_line, p.last_line, p.text) for p in r.p] for r in df.select("id", C.boundary_parts(F.col("t"), F.lit(1), F.col("e"), 4, 8).alias("p")).collect()}
    assert got == {1: [(0, 1, 2, "aaa\nbbb"), (1, 3, 3, "ccc")], 2: [], 3: []}
    md = spark.createDataFrame([(1, "intro\n# Page 3\n#Title  \nbody\n\nmore\n## Sub\n# page 4\nlast"), (2, "")], "id int, md string")
    rows = C.sections(md, "id", "md").orderBy("id", "section").collect()
    assert [(r.section, r.title, r.level, r.page, r.content) for r in rows] == [(0, None, 0, None, "intro"), (1, "Title", 1, 3, "body\n\nmore"), (2, "Sub", 2, 3, "last")]
    assert one(spark, C.under_heading(F.lit(" T "), F.lit(0), F.lit("x"))) == "# T\n\nx" and one(spark, C.under_heading(F.lit(""), F.lit(2), F.lit(" x"))) == "x"
    assert one(spark, C.paragraphs(F.lit("aaaa\n\nbb\n\ncccccccccccc\n\nd"), 8)) == ["aaaa\n\nbb", "cccccccccccc", "d"]


CODE = """within L.P;
// a part
// of it
model M "x"
  parameter Real a(unit="kg", min=0) = 2 "mass";
  final parameter Integer n = 3;
  Resistor R1(R=100, f(a=1)), C1 "store";
  input Real u "speed [rad/s]";
  SI.Voltage v;
  Real x(unit="m") = 1;
  Real x = 2;
  A.B.RealOutput y "out";
  Flange_a fl;
  annotation (Icon(x={(1)}), y="a") ;
  function f
   function inner
   end inner;
  end f;
equation
  connect(R1.p, C1.n);
  z = P.Q.g(1) + Math.sin(2); import K.L;
  annotation(Documentation(info="<p>Some &lt;b&gt; longer<br/>text &amp;lt;</p>"));
end M;"""


def test_extraction(spark):
    code = F.lit(CODE)
    assert [(p.name, p.type, p.default, p.description, p.unit, p.min) for p in one(spark, E.parameters(code))] == [("a", "Real", "2", "mass", "kg", "0"), ("n", "Integer", "3", None, None, None)]
    assert [tuple(c) for c in one(spark, E.connections(code))] == [("R1.p", "C1.n")]
    comps = [(c.name, c.type, list(c.prefixes), c.comment) for c in one(spark, E.bound(E.annotations_removed(code), E.components))]
    assert ("R1", "Resistor", [], None) in comps and ("C1", "Resistor", [], "store") in comps and ("u", "Real", ["input"], "speed [rad/s]") in comps and not any(c[0] in ("a", "n") for c in comps)
    names = [v.name for v in one(spark, E.bound(E.annotations_removed(code), E.variables))]
    assert names.count("x") == 1 and {"u", "v", "x", "y", "fl"} <= set(names)
    q = {r.name: (r.unit, r.quantity) for r in one(spark, E.quantities(code))}
    assert q == {"u": ("rad/s", None), "v": ("V", "ElectricPotential"), "x": ("m", None)}
    assert one(spark, E.dependencies(code)) == ["A.B", "K", "K.L", "L", "P.Q", "R1", "C1"][:0] + sorted({"A.B", "K", "K.L", "L", "P.Q", "R1", "C1", "SI"})
    ports = [(p.name, p.subtype, p.direction) for p in one(spark, E.interfaces(code))]
    assert ports == [("y", "RealOutput", "output"), ("fl", "MechanicalFlange", "bidirectional")]
    assert one(spark, E.documentation(code)) == "Some <b> longer text &lt;" and one(spark, E.documentation(F.lit('Documentation(info="<p>short</p>")'))) is None
    assert one(spark, E.leading_comment(code)) == "// a part\n// of it"
    assert "function extracted" in one(spark, E.without_functions(code)) and "end inner" not in one(spark, E.without_functions(code))
    clean = E.without_annotations(CODE)
    assert "annotation" not in clean and "connect" in clean and E.without_annotations(None) == "" and E.without_annotations("annotation(a(b)") == ""
    assert one(spark, E.class_kind(code)) == "model" and one(spark, E.class_kind(F.lit("x"))) == "unknown" and one(spark, E.class_kind(F.lit("partial model A\nend A;"))) == "partial model"
    assert [one(spark, E.unit_of(F.lit(c))) for c in ("a [m/s] b", "none")] == ["m/s", None]
    assert one(spark, E.padded(F.lit("ab"), 5)) == "ab   " and one(spark, E.padded(F.lit("ab"), 5, on_new_line=True)) == "ab\n   "


def test_code_block(spark):
    block = lambda t, mode="model": one(spark, E.code_block(F.lit(t), mode))
    text = "say\nmodel A\n Real x;\nend A;\nblock B end B;\n"
    assert block(text) == "block B\n end B;" and block(text, "instance") == "model A\n Real x;\nend A;" and block("nothing") is None
    assert block("function f\n y;\nend f;\nthe class C x end C; it") == "class C x end C;"
    assert block("model A\n Real x;\nend A;") == "model A\n Real x;\nend A;"


def brute_terms(text, limit=12):
    found = [m for p in (r"\b[A-Z]{2,}\b", r"\b[a-zA-Z_][a-zA-Z0-9_]{3,}\b", rf"\b\d+(?:\.\d+)?\s?(?:{E.UNITS})\b", r"\b[A-Z][a-z]{3,}\b") for m in re.findall(p, text)]
    out = {}
    for t in found:
        if t.lower() not in E.STOP:
            out.setdefault(t.lower(), t)
    return list(out.values())[:limit]


def test_queries_and_tex(spark):
    for t in ("Make PID control of 20 kPa at HEAT_x The temperature temperature Temperature 3.5 m/s for this model", "", "a b"):
        assert one(spark, E.terms(F.lit(t))) == brute_terms(t)
    assert one(spark, E.enriched(F.array(F.lit("a PID"), F.lit("b")), F.array(F.lit("pid"), F.lit("x")))) == ["a PID", "b x"]
    assert one(spark, E.enriched(F.array(F.lit("a")), F.array().cast("array<string>"))) == ["a"]
    assert one(spark, E.expanded_query(F.lit("a heat/pump, x"), "pdf")) == "heat pump " + E.TAILS["text"]
    assert len(one(spark, E.expanded_query(F.lit("word " * 40))).split()) == 20
    t = r"a $x$ and $$y" + "\n" + r"z$$ \[q\] \(r\) end $"
    s = one(spark, E.stashed(F.lit(t)))
    assert list(s.spans) == ["$x$", "$$y\nz$$", r"\[q\]", r"\(r\)"] and "$x$" not in s.text
    assert one(spark, E.restored(F.lit(s.text), F.array(*[F.lit(x) for x in s.spans]))) == t
    assert [one(spark, E.has_formula(F.lit(x))) for x in ("cost $5", r"\$5 \$6", "$5 or $6", "a ∑ b", "xαy", r"\[a\]")] == [False, False, True, True, False, True]
    assert [one(spark, E.document_type(F.lit(x))) for x in ("User_Guide.pdf", "apipaper", "Modelica", "x")] == ["manual", "technical_paper", "modelica_document", "general"]


def test_quantities_and_names(spark):
    code = 'model A\n Real x(unit="m", displayUnit="km", nominal=10, start=1);\n SI.Voltage v;\n Real w "[s]";\n Real n;\nend A;'
    got = {r.name: (r.unit, r.quantity, r.display_unit, r.nominal) for r in one(spark, E.quantities(F.lit(code)))}
    assert got == {"x": ("m", None, "km", "10"), "v": ("V", "ElectricPotential", None, None), "w": ("s", None, None, None)}
    tokens = ["a", "a.b", "_x1.é", "1a", "a.", ".a", "a..b", "if", "ends", "", "a b", "über"]
    assert one(spark, E.names_only(F.array(*[F.lit(t) for t in tokens]))) == ["a", "a.b", "ends"]
