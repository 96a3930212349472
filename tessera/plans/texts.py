"""Text queries: tokens, cleaning, extraction, features, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import extract as E
from tessera.operators import text as X
from tessera.operators import vector as V
from tessera.plans.registry import query

TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({TOK})::BIGINT AS n, {TOK}[1] AS first FROM documents")
def tokenize(t):
    k = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.get(k, F.lit(0)).alias("first"))


@query(f"""WITH q AS (SELECT doc_id AS query_id, list_distinct({TOK}) AS qt FROM documents WHERE doc_id % 20 = 0), d AS (SELECT doc_id, list_distinct({TOK}) AS dt FROM documents)
SELECT query_id, doc_id, CASE WHEN len(dt) = 0 OR len(qt) = 0 THEN 0 ELSE len(list_intersect(dt, qt)) / len(list_distinct(list_concat(dt, qt)))::DOUBLE END AS jaccard FROM d, q""")
def jaccard_score(t):
    d = t.documents.select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("words"))
    return V.jaccard_pairs(d, d.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def truncate_text(t):
    return t.documents.where(X.stripped(F.col("text")) != "").select("doc_id", X.truncated(F.col("text"), 200).alias("short"))


@query("SELECT c_custkey, concat_ws(' ', nullif(c_name, ''), CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END) AS joined FROM customer")
def concat_text_fields(t):
    seg = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return t.customer.select("c_custkey", X.joined_fields(F.col("c_name"), seg).alias("joined"))


SIGN = f"[{E.FORMULA_SIGNS}]"
FEATURES = rf"""regexp_matches(text, '(?s)(^|[^\\])\$(.*[^\\])?\$|\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$') OR regexp_matches(text, '(^|[^\p{{L}}\p{{N}}_]){SIGN}($|[^\p{{L}}\p{{N}}_])') AS formula,
  length(text) - length(replace(text, '|', '')) >= 6 AS tab, contains(text, '```') OR length(text) - length(replace(text, '`', '')) >= 4 AS code"""


@query(f"SELECT doc_id, formula, tab, code FROM (SELECT doc_id, {FEATURES} FROM documents)")
def detect_features(t):
    c = F.col("text")
    return t.documents.select("doc_id", E.has_formula(c).alias("formula"), X.has_table(c).alias("tab"), X.has_code(c).alias("code"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN code THEN 'code' WHEN formula THEN 'formula' WHEN tab THEN 'table' ELSE 'text' END AS kind FROM (SELECT {FEATURES} FROM documents)) GROUP BY 1")
def chunk_type(t):
    return t.documents.groupBy(E.chunk_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words, length(text)::BIGINT AS chars FROM documents")
def token_counts(t):
    return t.documents.select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


@query(f"SELECT doc_id, list_filter({E.KEYWORDS}, lambda k: contains(lower(text), k)) AS hits FROM documents")
def keyword_hits(t):
    return t.documents.select("doc_id", E.keywords(F.col("text")).alias("hits"))


@query(r"""SELECT page_id, body FROM (SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', ' ', 'g'), '<p[^>]*>|</p>', chr(10), 'g'), '<[^>]+>', '', 'g'),
'&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS body FROM pages) WHERE length(body) > 10""")
def html_to_text(t):
    return t.pages.select("page_id", E.html_text(F.col("html")).alias("body")).where(F.length("body") > 10)


@query()
def extract_terms(t):
    """The first twelve technical words of every document, in the order of their kinds."""
    return t.documents.select("doc_id", E.terms(F.col("text")).alias("terms"))


TAILED = """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(replace(replace(text, '/', ' '), ',', ' '), '\\s+'), lambda x: length(x) > 1) AS ws FROM benchmark)"""


@query(TAILED + f"""SELECT item_id, f.focus, CASE WHEN len(ws) < 20 THEN array_to_string(ws, ' ') || ' ' || f.tail ELSE array_to_string(ws[1 : greatest(15, len(ws) // 2)], ' ') END AS q
FROM w, (VALUES ('functions', '{E.TAILS["code"]}'), ('pdf', '{E.TAILS["text"]}')) f(focus, tail)""")
def optimize_query(t):
    """Short queries get the tail of their focus; long ones keep their first half, 15 words at least."""
    both = [t.benchmark.select("item_id", F.lit(f).alias("focus"), E.expanded_query(F.col("text"), f).alias("q")) for f in ("functions", "pdf")]
    return both[0].unionByName(both[1])


@query()
def enrich_queries(t):
    """Three variants of each query, each with one of its own technical words in turn."""
    said = F.array(F.concat("text", F.lit(" overview")), F.concat("text", F.lit(" parameters")), F.col("text"))
    return t.benchmark.select("item_id", F.posexplode(E.enriched(said, E.terms(F.col("text")))).alias("variant", "q"))


@query("""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[-*0-9. ]+', ''), '^\\s+|\\s+$', '', 'g')),
  lambda x: length(x) >= 8 AND NOT regexp_matches(lower(x), 'select | from | where |[{}]')) AS lines FROM documents""")
def clean_candidates(t):
    lines = F.transform(F.split("text", "\n"), lambda x: X.stripped(F.regexp_replace(x, r"^[-*0-9. ]+", "")))
    return t.documents.select("doc_id", F.filter(lines, lambda x: (F.length(x) >= 8) & ~F.lower(x).rlike(r"select | from | where |[{}]")).alias("lines"))


@query("SELECT lang, count(*) AS n, sum(CASE WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 1 ELSE 0 END)::BIGINT AS cjk, sum(CASE WHEN regexp_matches(text, '[À-ÿ]') THEN 1 ELSE 0 END)::BIGINT AS accents FROM documents GROUP BY 1")
def script_check(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"[\x{4E00}-\x{9FFF}]")).alias("cjk"), F.count_if(F.col("text").rlike("[À-ÿ]")).alias("accents"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (starts_with(x, 'The') OR starts_with(x, 'All rights'))), chr(10)) AS body FROM documents")
def drop_prefixed_lines(t):
    return t.documents.select("doc_id", X.dropped_lines(F.col("text"), ["The", "All rights"]).alias("body"))


@query("SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN regexp_replace(substr(text, 5), '^\\s+|\\s+$', '', 'g') ELSE text END AS body FROM documents")
def strip_prefix(t):
    return t.documents.select("doc_id", F.when(F.col("text").startswith("The "), X.stripped(F.expr("substring(text, 5)"))).otherwise(F.col("text")).alias("body"))


REPLY = """CASE conv_id % 4 WHEN 0 THEN 'x ```json' || chr(10) || '{"confidence": "85%", "facts": ["a", "b"]}' || chr(10) || '```' WHEN 1 THEN '{"confidence": 1.7}' WHEN 2 THEN 'no json here' ELSE 'so {"confidence": 0.25, "facts": []} ok' END"""


@query(f"""WITH r AS (SELECT conv_id, turn, {REPLY} AS reply FROM conversations), j AS (SELECT *, regexp_extract(reply, '(?s)\\{{.*\\}}') AS js FROM r),
c AS (SELECT *, CASE WHEN js <> '' THEN json_extract_string(js, '$.confidence') END AS raw FROM j)
SELECT conv_id, turn, CASE WHEN raw IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN ends_with(raw, '%') THEN CAST(replace(raw, '%', '') AS DOUBLE) / 100 ELSE CAST(raw AS DOUBLE) END)) END::DOUBLE AS confidence,
  CASE WHEN js <> '' THEN coalesce(json_array_length(js, '$.facts'), 0) ELSE 0 END::BIGINT AS facts FROM c""")
def parse_llm_json(t):
    """JSON in a fence or between the first and last brace; a confidence in percent or 0..1, clamped; .5 without one."""
    reply = F.expr(REPLY.replace("chr(10)", "char(10)"))
    js = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    got = F.from_json(js, "confidence string, facts array<string>")
    raw = got["confidence"]
    value = F.when(raw.endswith("%"), F.regexp_replace(raw, "%", "").try_cast("double") / 100).otherwise(raw.try_cast("double"))
    facts = F.when(got["facts"].isNull(), 0).otherwise(F.size(got["facts"]))
    return t.conversations.select("conv_id", "turn", F.when(value.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("confidence"), F.coalesce(facts, F.lit(0)).cast("long").alias("facts"))


CODE = """'text before' || chr(10) || CASE event_id % 4 WHEN 0 THEN 'model M' || event_id || chr(10) || ' Real x;' || chr(10) || 'end M' || event_id || ';' WHEN 1 THEN 'model C end C;' || chr(10) || 'block B' || chr(10) || ' Real y; ' || chr(10) || 'end B;' || chr(10) WHEN 2 THEN 'see class K is x end K; and function F x end F;' ELSE 'nothing' END || chr(10) || 'after'"""


@query(rf"""WITH c AS (SELECT event_id, {CODE} AS code FROM events), k AS (SELECT *, regexp_extract(code, '(?m)^\s*(block|model) (\w+)\s*((?s:.*?))\bend (B|M\d+);$', 2) AS name FROM c)
SELECT event_id, coalesce(nullif(CASE WHEN contains(code, 'block B') THEN 'block B' || chr(10) || ' Real y; ' || chr(10) || 'end B;' END, ''), nullif(regexp_extract(code, '(?s)class\s+(\w+).*?end K;'), ''),
  CASE WHEN starts_with(name, 'M') THEN 'model ' || name || chr(10) || ' Real x;' || chr(10) || 'end ' || name || ';' END, '') AS body FROM k""")
def extract_block(t):
    """The definition of a reply: block before class before model before function, strict before loose."""
    code = F.expr(CODE.replace("chr(10)", "char(10)").replace("|| event_id", "|| cast(event_id as string)"))
    return t.events.select("event_id", F.coalesce(E.code_block(code), F.lit("")).alias("body"))


@query("""SELECT url, CASE WHEN regexp_matches(lower(url), 'manual|guide|handbook') THEN 'manual' WHEN regexp_matches(lower(url), 'paper|journal|conference') THEN 'technical_paper' WHEN regexp_matches(lower(url), 'api|reference|doc') THEN 'reference' WHEN contains(lower(url), 'modelica') THEN 'modelica_document' ELSE 'general' END AS kind FROM pages""")
def doc_type(t):
    return t.pages.select("url", E.document_type(F.col("url")).alias("kind"))


@query("""WITH n AS (SELECT p_partkey, lower(p_name) || CASE p_size % 5 WHEN 0 THEN 'Spring' WHEN 1 THEN 'HeatConvection' WHEN 2 THEN 'resistorVoltage' WHEN 3 THEN 'flow' ELSE '' END AS name, CASE WHEN p_size % 7 = 0 THEN 'Lib.Rotational' ELSE p_type END AS pkg FROM part),
d AS (SELECT p_partkey, lower(name) AS name, CASE WHEN contains(lower(pkg), 'thermal') THEN 'thermal' WHEN contains(lower(pkg), 'electrical') THEN 'electrical' WHEN regexp_matches(lower(pkg), 'rotational|translational') THEN 'mechanical' WHEN contains(lower(pkg), 'fluid') THEN 'fluid'
  WHEN regexp_matches(lower(name), 'heat|thermal|temperature|convect') THEN 'thermal' WHEN regexp_matches(lower(name), 'electric|voltage|current|resistor|capacitor') THEN 'electrical'
  WHEN regexp_matches(lower(name), 'rotational|mechanical|torque|force|motion|backlash|spring|damper') THEN 'mechanical' WHEN regexp_matches(lower(name), 'fluid|hydraulic|pneumatic|flow') THEN 'fluid' END AS domain FROM n)
SELECT p_partkey, domain, CASE WHEN domain = 'mechanical' AND regexp_matches(name, 'spring|elastic') THEN 'hookes_law' WHEN domain = 'mechanical' AND regexp_matches(name, 'damper|friction') THEN 'viscous_damping' WHEN domain = 'mechanical' AND contains(name, 'backlash') THEN 'nonlinear_contact'
  WHEN domain = 'thermal' AND contains(name, 'convect') THEN 'heat_convection' WHEN domain = 'thermal' AND contains(name, 'conduct') THEN 'heat_conduction' WHEN domain = 'electrical' AND regexp_matches(name, 'resistor|resistance') THEN 'ohms_law' END AS law FROM d""")
def domain_infer(t):
    size = F.col("p_size")
    name = F.concat(F.lower("p_name"), F.when(size % 5 == 0, "Spring").when(size % 5 == 1, "HeatConvection").when(size % 5 == 2, "resistorVoltage").when(size % 5 == 3, "flow").otherwise(""))
    rows = t.part.select("p_partkey", name.alias("name"), F.when(size % 7 == 0, "Lib.Rotational").otherwise(F.col("p_type")).alias("pkg"))
    rows = rows.withColumn("domain", E.physical_domain(F.col("name"), F.col("pkg")))
    return rows.select("p_partkey", "domain", E.phenomenon(F.col("name"), F.col("domain"))["physical_law"].alias("law"))


@query(r"SELECT doc_id, regexp_extract_all(text, '(?s)\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$') AS spans FROM documents")
def math_spans(t):
    return t.documents.select("doc_id", E.math_spans(F.col("text")).alias("spans"))


@query("SELECT doc_id, true AS same, sha1(text || ' $a_1$ \\[b' || chr(10) || '\\] $$c$$') AS digest FROM documents")
def tex_round_trip(t):
    """TeX spans out of the text and back in: the same text as before."""
    said = F.concat("text", F.lit(" $a_1$ \\[b\n\\] $$c$$"))
    rows = t.documents.select("doc_id", said.alias("said"), E.stashed(said).alias("s"))
    back = rows.select("doc_id", "said", E.restored(F.col("s.text"), F.col("s.spans")).alias("back"))
    return back.select("doc_id", (F.col("said") == F.col("back")).alias("same"), F.sha1("back").alias("digest"))


@query("""SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || substr(text, 1, 300), chr(10) ORDER BY turn, role, text) AS context
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) <= 10) GROUP BY 1""")
def render_context(t):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), F.substring("text", 1, 300))
    rows = t.conversations.withColumn("n", n).where("n <= 10").select("conv_id", "n", line.alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("context"))


@query("SELECT doc_id, (octet_length(encode('doc' || source)) + octet_length(encode(text)) + 80 * (length(lang) + 1) + 120)::BIGINT AS estimate FROM documents")
def content_estimate(t):
    return t.documents.select("doc_id", (F.octet_length(F.concat(F.lit("doc"), "source")) + F.octet_length("text") + 80 * (F.length("lang") + 1) + 120).cast("long").alias("estimate"))


MARKDOWN = "'# Page ' || page_id || chr(10) || regexp_replace(replace(replace(html, '<h1>', chr(10) || '## '), '<p>', chr(10)), '<[^>]*>', '', 'g')"


def page_lines(t):
    md = F.concat(F.lit("# Page "), F.col("page_id").cast("string"), F.lit("\n"), F.regexp_replace(F.replace(F.replace("html", F.lit("<h1>"), F.lit("\n## ")), F.lit("<p>"), F.lit("\n")), r"<[^>]*>", ""))
    lines = t.pages.select("page_id", F.posexplode(F.split(md, "\n")).alias("line_no", "line"))
    w = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("#")
    page = F.when(F.col("line").rlike(r"(?i)^#+ *page \d+"), F.regexp_extract("line", r"(\d+)", 1).cast("long"))
    return lines.select("page_id", F.col("line_no").cast("long"), "line", head.alias("head"), F.sum(head.cast("long")).over(w).alias("section"), F.last(page, ignorenulls=True).over(w).alias("page"))


LINES = f"""WITH m AS (SELECT page_id, string_split({MARKDOWN}, chr(10)) AS ls FROM pages), l AS (SELECT page_id, unnest(range(len(ls))) AS line_no, ls FROM m),
x AS (SELECT page_id, line_no, ls[line_no + 1] AS line FROM l),
y AS (SELECT *, starts_with(line, '#') AS head, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER w AS section,
  last_value(CASE WHEN regexp_matches(line, '(?i)^#+ *page \\d+') THEN CAST(regexp_extract(line, '(\\d+)', 1) AS BIGINT) END IGNORE NULLS) OVER w AS page
  FROM x WINDOW w AS (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


@query(LINES + "SELECT page_id, line_no::BIGINT AS line_no, page::BIGINT AS page FROM y")
def carry_forward(t):
    return page_lines(t).select("page_id", "line_no", "page")


@query(LINES + "SELECT page_id, section::BIGINT AS section, max(CASE WHEN head THEN regexp_replace(line, '^#+ *', '') END) AS title, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM y GROUP BY 1, 2")
def markdown_sections(t):
    title = F.max(F.when(F.col("head"), F.regexp_replace("line", "^#+ *", "")))
    return page_lines(t).groupBy("page_id", "section").agg(title.alias("title"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


REPLIED = """WITH w AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')[1:3] AS facts, (turn % 15) / 10.0 AS c FROM conversations) """


def replies(t):
    """A model's replies as text, made from conversations: JSON in a marked or a plain fence, alone, with a percentage, in a
    sentence, or none."""
    k = F.col("conv_id") % 6
    facts = F.slice(F.filter(F.split("text", r"[ \n]+"), lambda x: x != ""), 1, 3)
    confidence = F.when(k == 4, F.concat((F.col("turn") % 15 * 10).cast("string"), F.lit("%"))).otherwise((F.col("turn") % 15 / 10).cast("string"))
    js = F.to_json(F.struct(F.col("role").alias("intent"), F.col("text").alias("optimized_query"), confidence.alias("confidence"), F.col("text").alias("analysis"), facts.alias("facts"), facts.alias("issues")))
    cat = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    reply = F.when(k == 0, cat("So:\n```json\n", js, "\n``` done")).when(k == 1, cat("```\n", js, "```")).when(k == 3, F.col("text")).when(k == 5, cat("I say ", js, " here")).otherwise(js)
    return t.conversations.select("conv_id", "turn", "role", reply.alias("reply"))


@query(REPLIED + """SELECT conv_id, turn, role, conv_id % 6 NOT IN (3, 5) AS parsed, CASE WHEN conv_id % 6 IN (3, 5) THEN 'query' ELSE role END AS intent, CASE WHEN conv_id % 6 = 3 THEN substr(text, 1, 200) WHEN conv_id % 6 <> 5 THEN text END AS query,
  CASE WHEN conv_id % 6 IN (3, 5) THEN 0.5 ELSE least(1.0, c) END::DOUBLE AS confidence FROM w""")
def reply_analysis(t):
    """What an analyser's reply says, with its fallback; in a sentence JSON isn't read."""
    from tessera.functions import replies as R

    a = replies(t).select("conv_id", "turn", "role", R.analysis(F.col("reply")).alias("a"))
    said = F.when((F.col("conv_id") % 6 != 5), F.col("a.optimized_query"))
    return a.select("conv_id", "turn", "role", "a.parsed", "a.intent", said.alias("query"), F.round("a.confidence", 6).alias("confidence"))


@query(REPLIED + f"""SELECT conv_id, turn, role, CASE WHEN conv_id % 6 IN (3, 5) THEN [] ELSE facts END AS facts, CASE WHEN conv_id % 6 IN (3, 5) THEN ['JSONパース失敗'] ELSE [] END AS gaps,
  CASE WHEN conv_id % 6 = 3 AND NOT contains(text, '{{') THEN [] WHEN conv_id % 6 = 4 OR conv_id % 6 <> 3 THEN facts ELSE [] END AS issues, CASE WHEN conv_id % 6 = 3 THEN 0.7 ELSE c END::DOUBLE AS confidence FROM w""")
def reply_expertise(t):
    """Lists of an expert's reply, and issues and confidence of the same text as a validator's, which is read from the first
    to the last brace."""
    from tessera.functions import replies as R

    r = replies(t).select("conv_id", "turn", "role", R.expertise(F.col("reply")).alias("e"), R.validation(F.col("reply")).alias("v"))
    return r.select("conv_id", "turn", "role", "e.facts", "e.gaps", "v.issues", F.round("v.confidence", 6).alias("confidence"))


@query("SELECT doc_id, doc_id % 3 = 0 AS again FROM documents WHERE NOT regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{FF66}-\\x{FF9D}]')")
def caption_retry(t):
    """Captions with ideographs and no kana are asked for again: documents without either get some."""
    from tessera.functions import replies as R

    plain = t.documents.where(~F.col("text").rlike(R.CJK) & ~F.col("text").rlike(R.KANA))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("図面"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("図のｱ"))).otherwise(F.col("text"))
    return plain.select("doc_id", R.in_other_script(said).alias("again"))
