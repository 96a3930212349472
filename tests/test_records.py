import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.lexer import definitions
from tessera.operators import records as R
from tessera.operators import schema as S

NOISE = ["// model A", "/* end P; package Q */", "// end M0;", "/* function f */", "// it's \"quoted", "/* 'x */"]
STRINGS = ['"end M0; model X"', '"a \\" end M1; function g"', '"/* no comment"', '"// none"']
KINDS = ["package", "model", "block", "class", "record", "connector", "function"]


def written(r, depth, names, out, scope, parent):
    """Appends a random definition to out (a list of pieces); returns what a reader has to find, children after it."""
    name = f"N{len(names)}"
    names.append(name)
    number, kind = len(names) - 1, r.choice(KINDS)
    want = {"number": number, "parent": parent, "kind": kind, "name": name, "scope": list(scope), "first": sum(map(len, out))}
    found, own, bare = [want], [], []

    def say(text, both=True):
        out.append(text)
        own.append(text)
        if both:
            bare.append(text)

    say(r.choice(["", "partial ", "encapsulated "]) + f"{kind} {name}" + r.choice(["", " " + r.choice(STRINGS)]) + "\n")
    statements = []
    for _ in range(r.randint(0, 4)):
        what = r.random()
        if what < 0.3 and depth < 5:
            found += written(r, depth + 1, names, out, [*scope, name], number)
            say(" ")
        elif what < 0.5:
            say(r.choice(NOISE), False)
            say("\n")
        else:
            say(r.choice([f"  Real x{r.randint(0, 9)} {r.choice(STRINGS)};\n", "  Real y[3] = {1, a[end], 2};\n", "  Real z(start=1);\n"]))
    if kind not in ("record", "connector", "package") and r.random() < 0.7:
        say("equation\n")
        for k in range(r.randint(0, 3)):
            s = r.choice([f"x{k} = f(a[end]) + {k}", f"connect(a.b, c[{k}])", f'assert(x > {k}, {r.choice(STRINGS)})'])
            say("  ")
            say(s)
            say(r.choice(["", " /* end X; */ "]), False)
            say(";\n")
            statements.append(s)
        if r.random() < 0.3:
            say("  when x > 1 then y = 2; end when;\n")
            statements += ["when x > 1 then y = 2", "end when"]
    say(f"end {name};")
    want |= {"last": sum(map(len, out)), "own": "".join(own), "bare": "".join(bare), "statements": statements}
    return found


@pytest.mark.parametrize("seed", range(40))
def test_lexer_against_the_writer(seed):
    r, out, names, want = random.Random(seed), ["within Top.Lib;\n"], [], []
    for _ in range(r.randint(1, 4)):
        want += written(r, 0, names, out, ["Top", "Lib"], -1)
        out.append("\n")
    text = "".join(out)
    got = definitions(text)
    for w, g in zip(want, got, strict=True):
        assert {k: g[k] for k in ("number", "parent", "kind", "name", "scope", "first", "last", "own")} == {k: w[k] for k in ("number", "parent", "kind", "name", "scope", "first", "last", "own")}
        assert "".join(w["bare"].split()).endswith("".join(g["bare"].split())) and g["closed"] and [s["str"] for x in g["sections"] for s in x["statements"]] == w["statements"]
        assert g["first_line"] == text.count("\n", 0, g["first"]) + 1 and g["last_line"] == text.count("\n", 0, g["last"]) + 1
    assert sum(len(g["own"]) for g in got) <= len(text)


def test_lexer_edges():
    assert definitions(None) == definitions("") == definitions("model") == definitions("// model A end A;") == definitions('"model A') == []
    name = lambda text: [(d["kind"], d["name"], d["parent"], d["closed"], d["last_line"]) for d in definitions(text)]
    assert name("model A end B; end if; end A") == [("model", "A", -1, True, 1)]
    assert name("model A\n model B\n Real x;\nend A;\nmodel C end C;") == [("model", "A", -1, True, 4), ("model", "B", 0, False, 3), ("model", "C", -1, True, 5)]
    assert name('type V = Real(unit="V");\nfunction g = f(a=[1, 2; 3, 4]); package P = Q;') == [("type", "V", -1, True, 1), ("function", "g", -1, True, 2), ("package", "P", -1, True, 2)]
    assert name("model M(x = function f(a); model N end N; end M;") == [("model", "M", -1, True, 1), ("model", "N", 0, True, 1)]
    d = definitions("// far\n\nReal x;\n// one\n/* two */\nfinal model A extends Base.B(k=1);\n extends C; import M = X.Y; import Z.*; import Z.W;\nend A;")
    assert (d[0]["comment"], d[0]["name"], d[0]["extends"], d[0]["imports"]) == ("// one\n/* two */", "A", ["Base.B", "C"], ["X.Y", "Z", "Z.W"]) and d[0]["closed"]
    d = definitions("redeclare model extends Base(k=1)\n Real x; end Base;")[0]
    assert (d["name"], d["extends"], d["closed"], d["own"][:9]) == ("Base", ["Base"], True, "redeclare")
    d = definitions("model Ä 'µ'; initial algorithm a := 1; b := 2; equation c = 3; public Real q; protected Real r; annotation(x=1); end Ä;")[0]
    assert [(s["section"], s["initial"], [x["str"] for x in s["statements"]]) for s in d["sections"]] == [("algorithm", True, ["a := 1", "b := 2"]), ("equation", False, ["c = 3"])]
    assert "Real r" in d["declared"] and "c = 3" not in d["declared"]


FILE = """within Lib;
// A <b>short</b> note
model HeatModel "x"
  extends Base.Part;
  parameter Real k(unit="W", min = f(1, 2), max=9) = 2   *  3 "gain [W]";
  Real v(start=1, nominal={1,2}, quantity="Speed, linear") "v"; // Real w;
  R r1(R=10, name="a,b", redeclare package M = Water, R=11), r2;
  function f
    input Real u;
  algorithm
  end f;
equation
  v = sample(0, 1) * pre(k) + edge(k) + noEvent(k); // x = y;
end HeatModel;
"""


def test_records(spark):
    files = spark.createDataFrame([("a.mo", FILE), ("b.mo", None), ("c.mo", ""), ("a.mo", FILE)], "path string, text string")
    rows = R.records(R.symbols(files, "text", ["path"]), "path", version="2", stamp=F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()
    m, f = sorted(rows[:2], key=lambda x: x.fqn)
    assert len(rows) == 4 and (m.fqn, f.fqn, m.package_path, f.package_path) == ("Lib.HeatModel", "Lib.HeatModel.f", ["Lib"], ["Lib", "HeatModel"])
    own = FILE[FILE.index("model HeatModel") : FILE.index("function f")] + FILE[FILE.index("\nequation") : -1]
    sha = hashlib.sha1(own.encode()).hexdigest()
    assert m.id == f"Lib.HeatModel|model|2|{sha}|3-14" and m.metadata.timestamp == "2024-01-02T03:04:05.000000Z" and m.code_text == own and len(f.code_text) >= 50
    p, = m.parameters
    assert (p.name, p.default, p.unit, p.max, p.description) == ("k", "2 * 3", "W", "9", "gain [W]")
    assert {c.name: c.modifications for c in m.components} == {"v": {"start": "1", "nominal": "{1,2}", "quantity": '"Speed, linear"'}, "r1": {"R": "11", "name": '"a,b"', "redeclare_0": "package M = Water"}, "r2": {}}
    v, = m.variables
    assert v.attributes == {"start": "1", "nominal": "{1,2}", "quantity": "Speed, linear"} and v.comment == "v"
    item, = m.equations[0]["items"]
    assert item.ops == ["pre", "noEvent", "sample", "edge"] and item.phase == "runtime" and m.physical_domain.domain == "thermal"
    assert m.documentation.info == "// A <b>short</b> note" and f.documentation is None and f.equations[0]["items"] == [] and f.statistics.code_lines == 4
    assert R.records(R.symbols(files.limit(0), "text", ["path"]), "path").count() == 0


def test_checks_of_a_set(spark):
    files = spark.createDataFrame([("a", FILE), ("a", FILE), ("b", "package P model HeatModel end HeatModel; end P;")], "path string, text string")
    recs = R.records(R.symbols(files, "text", ["path"]), "path").withColumn("kind", F.when(F.col("fqn") == "P", "unknown").otherwise(F.col("kind")))
    said = sorted((i.code, i.target_id) for i in R.issues(recs, most=450, eqs=0, params=0, comps=2).collect())
    assert [c for c, _ in said] == ["DUPLICATE_CONTENT", "DUPLICATE_IDS", "MANY_COMPONENTS", "MANY_COMPONENTS", *["MANY_EQUATIONS"] * 6, "MANY_PARAMS", "MANY_PARAMS", "MISSING_CORE", "OVERSIZE", "OVERSIZE"]
    assert R.issues(recs.limit(0)).count() == 0 and R.quality(recs.limit(0)).first().total == 0
    q = R.quality(recs).first()
    assert (q.total, q.kinds, q.dupe_ids, q.dupe_signatures) == (6, {"function": 2, "model": 3, "unknown": 1}, 2, 2)
    z = R.splits(recs, 60).first()
    assert (z.records, z.smallest, z.over, z.dupe_ids) == (6, 50, 2, 2)
    got = {r.package: r for r in R.packages(recs).collect()}
    assert got["Lib"].first == ["Lib.HeatModel"] * 2 and [tuple(c) for c in got["Lib"].children] == [("HeatModel", 2)] and set(got) == {"Lib", "Lib.HeatModel", "P"}
    lines = R.entries(recs).select("json").unionByName(spark.createDataFrame([("{",), ("",), ("{}",), ('{"collections": {"ast_record": {"kind": 3}}} x',)], "json string"))
    f = R.file_report(lines, "json").first()
    assert (f.lines, f.errors, f.dupe_ids) == (9, 2, 2) and f.kinds == {"function": 2, "model": 3, "unknown": 2} and [tuple(p) for p in f.packages] == [("Lib", 2), ("Lib.HeatModel", 2), ("P", 1)]
    none = R.file_report(lines.limit(0), "json").first()
    assert (none.lines, none.errors, none.longest, none.mean, none.kinds, none.packages) == (0, 0, 0, 0, {}, [])
    line = json.loads(R.entries(recs).first().json)
    assert line["validation_rules"] == R.VALIDATION_RULES and line["collections"]["ast_record"]["neighbors"]["used_by"] == []


def test_schema_constants_and_integers(spark):
    schema = {"type": "object", "properties": {
        "n": {"type": "integer", "const": 2}, "t": {"const": "x"}, "b": {"type": "boolean", "const": True}, "o": {"const": {"a": [1, {"z": None}], "b": 2}}, "e": {"enum": [1, "1", None, [1]]}, "any": {}, "z": {"const": None},
        "d": {"type": ["array", "null"], "items": {"type": "integer", "minimum": 1}}, "k": {"type": "integer"}}, "additionalProperties": False}
    said = lambda doc: sorted(f"{r.path}:{r.code}" for r in S.schema_errors(spark.createDataFrame([(json.dumps(doc) if not isinstance(doc, str) else doc,)], "raw string"), "raw", schema, []).collect())
    assert said({"n": 2, "t": "x", "b": True, "o": {"b": 2, "a": [1, {"z": None}]}, "e": None, "any": [1], "z": None, "d": None, "k": 10**30}) == []
    assert said('{"n": 2.0, "e": [1], "k": 1e3, "d": [1, 2.0]}') == [] == said({"e": "1"}) == said({"e": 1.0})
    assert said({"n": 3, "t": 5, "b": False, "o": {"a": [1], "b": 2}, "e": 2, "z": 0, "d": [0.5], "k": 1.5}) == ["b:CONST", "d[]:MINIMUM", "d[]:TYPE", "e:ENUM", "k:TYPE", "n:CONST", "o:CONST", "t:CONST", "z:CONST"]
    assert said('{"n": 2} x') == said('{"n": 2}{"n": 2}') == said('{"n": 2},{"n": 3}') == said("1],[2") == said("1}{2") == said("") == ["$:JSON_PARSE"] and said(" [1] ") == ["$:TYPE"]
    assert said({"n": "2", "b": 1, "e": "x", "q": 1}) == ["$:ADDITIONAL", "b:CONST", "b:TYPE", "e:ENUM", "n:CONST", "n:TYPE"]
