"""Chunk queries: sections under headings, packed paragraphs and lines, boundary-aware splits, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import chunking as C
from tessera.functions import extract as E
from tessera.operators import text as X
from tessera.plans.registry import query
from tessera.plans.texts import FEATURES

LIMIT = 1000
#: Pages as Markdown: a page heading, sections, paragraphs between blank lines.
MARKDOWN = r"'# Page ' || page_id || chr(10) || regexp_replace(replace(replace(html, '<h1>', chr(10) || '## '), '<p>', chr(10) || chr(10)), '<[^>]*>', '', 'g')"


def markdown(t):
    md = F.concat(F.lit("# Page "), F.col("page_id").cast("string"), F.lit("\n"), F.regexp_replace(F.replace(F.replace("html", F.lit("<h1>"), F.lit("\n## ")), F.lit("<p>"), F.lit("\n\n")), r"<[^>]*>", ""))
    return t.pages.select("page_id", md.alias("md"))


SECTIONS = f"""
WITH RECURSIVE m AS (SELECT page_id, string_split({MARKDOWN}, chr(10)) AS ls FROM pages), l0 AS (SELECT page_id, unnest(range(len(ls))) AS pos, ls FROM m),
l1 AS (SELECT page_id, pos, ls[pos + 1] AS line, regexp_matches(ls[pos + 1], '(?i)^#+\\s*page\\s+\\d+\\s*$') AS is_page FROM l0),
l2 AS (SELECT *, starts_with(line, '#') AND NOT is_page AS head FROM l1),
l3 AS (SELECT *, sum(head::INT) OVER w AS section, last_value(CASE WHEN is_page THEN regexp_extract(line, '(\\d+)', 1)::BIGINT END IGNORE NULLS) OVER w AS page FROM l2 WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
s0 AS (SELECT page_id, section::BIGINT AS section, max(CASE WHEN head THEN regexp_replace(line, '^#+\\s*|\\s+$', '', 'g') END) AS title, coalesce(max(CASE WHEN head THEN length(regexp_extract(line, '^(#+)', 1)) END), 0)::BIGINT AS level, min_by(page, pos) AS page,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head AND NOT is_page), ''), '^\\s+|\\s+$', '', 'g') AS content FROM l3 GROUP BY 1, 2),
s AS (SELECT * FROM s0 WHERE content <> '' OR coalesce(title, '') <> ''),
b AS (SELECT *, CASE WHEN coalesce(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '') = '' THEN content ELSE regexp_replace(repeat('#', greatest(level, 1)::INT) || ' ' || regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || content, '^\\s+|\\s+$', '', 'g') END AS body FROM s),
p AS (SELECT page_id, section, body, string_split(body, chr(10) || chr(10)) AS ps FROM b WHERE length(body) > {LIMIT}),
r(page_id, section, ps, i, cur, chunk) AS (
  SELECT page_id, section, ps, 0::BIGINT, '', NULL::VARCHAR FROM p
  UNION ALL
  SELECT page_id, section, ps, i + 1, CASE WHEN i = len(ps) THEN '' WHEN cur <> '' AND length(cur) + length(ps[i + 1]) > {LIMIT} THEN ps[i + 1] || chr(10) || chr(10) ELSE cur || ps[i + 1] || chr(10) || chr(10) END,
    CASE WHEN i = len(ps) THEN cur WHEN cur <> '' AND length(cur) + length(ps[i + 1]) > {LIMIT} THEN cur END
  FROM r WHERE i <= len(ps)),
c AS (SELECT page_id, section, i, regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') AS chunk FROM r WHERE chunk IS NOT NULL UNION ALL SELECT page_id, section, 0, body FROM b WHERE length(body) <= {LIMIT}),
k AS (SELECT page_id, section, row_number() OVER (PARTITION BY page_id, section ORDER BY i) - 1 AS seq, chunk, chunk AS text FROM c WHERE chunk <> '')
"""


def section_bodies(t):
    s = C.sections(markdown(t), "page_id", "md")
    return s.withColumn("body", C.under_heading(F.col("title"), F.col("level"), F.col("content")))


def chunks(t):
    rows = section_bodies(t).select("page_id", "section", F.posexplode(C.paragraphs(F.col("body"), LIMIT)).alias("seq", "chunk"))
    return rows.withColumn("seq", F.col("seq").cast("long"))


@query(SECTIONS + "SELECT page_id, section, title, level, page, length(content)::BIGINT AS chars, sha1(body) AS digest FROM b")
def page_sections(t):
    """Sections with title, level and page, each below its heading again."""
    return section_bodies(t).select("page_id", "section", "title", F.col("level").cast("long"), "page", F.length("content").cast("long").alias("chars"), F.sha1("body").alias("digest"))


@query(SECTIONS + "SELECT page_id, section, seq, chunk FROM k")
def chunk_paragraphs(t):
    """Whole paragraphs packed into chunks of at most LIMIT characters; one over the limit stays whole."""
    return chunks(t).select("page_id", "section", "seq", "chunk")


@query(SECTIONS + f"""SELECT coalesce(kind, 'all') AS kind, count(*) AS n, coalesce(sum(length(chunk)), 0)::BIGINT AS chars, coalesce(round(avg(length(chunk)), 4), 0) AS mean
FROM (SELECT chunk, CASE WHEN code THEN 'code' WHEN formula THEN 'formula' WHEN tab THEN 'table' ELSE 'text' END AS kind FROM (SELECT chunk, {FEATURES} FROM k)) GROUP BY ROLLUP (kind)""")
def chunk_stats(t):
    """Counts and sizes of chunks by kind and of all; without any chunk one row of zeros."""
    rows = chunks(t).select(F.length("chunk").alias("n_chars"), E.chunk_kind(F.col("chunk")).alias("kind"))
    out = rows.rollup("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("long").alias("chars"), F.coalesce(F.round(F.avg("n_chars"), 4), F.lit(0.0)).alias("mean"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


SOFT, HARD = 600, 1000


def numbered(extra: str) -> str:
    return f"""WITH RECURSIVE l AS (SELECT doc_id, ls, len(ls) AS n FROM (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents) WHERE length(text) > {HARD} {extra}),
w AS (SELECT doc_id, text FROM documents WHERE text <> '' AND NOT (length(text) > {HARD} {extra})),"""


LINES = numbered("") + f"""
r(doc_id, i, start, size) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM l UNION ALL
  SELECT doc_id, i + 1, CASE WHEN i > start AND size + length(ls[i + 1]) + 1 > {SOFT} THEN i ELSE start END, CASE WHEN i > start AND size + length(ls[i + 1]) + 1 > {SOFT} THEN 0 ELSE size END + length(ls[i + 1]) + 1 FROM r JOIN l USING (doc_id) WHERE i < n),
p AS (SELECT doc_id, start, max(i) AS stop FROM r WHERE i > 0 GROUP BY 1, 2),
o AS (SELECT doc_id, start + 1 AS first_line, stop AS last_line, regexp_replace(array_to_string(ls[start + 1 : stop], chr(10)), '\\n+$', '') AS part FROM p JOIN l USING (doc_id)),
u AS (SELECT * FROM o WHERE part <> '' UNION ALL SELECT doc_id, 1, greatest(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))), 1), text FROM w)
SELECT doc_id, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, length(part)::BIGINT AS chars, sha1(part) AS digest FROM u"""


@query(LINES)
def chunk_lines(t):
    """Every part of every document: whole lines up to the soft limit, with line numbers."""
    rows = C.line_rows(t.documents, ["doc_id"], "text", SOFT, HARD)
    return rows.select("doc_id", "first_line", "last_line", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("digest"))


ENDS = "AND len(list_filter(string_split(text, chr(10)), lambda x: ends_with(x, '.'))) > 0"
BOUNDARY = numbered(ENDS) + f"""
z(doc_id, i, start, size, last, a, b) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM l UNION ALL
  SELECT doc_id, i + 1, CASE WHEN cut IS NULL THEN start ELSE greatest(cut - 1, start) + 1 END, CASE WHEN cut IS NULL THEN size ELSE 0 END, CASE WHEN cut IS NULL THEN last END, CASE WHEN cut IS NOT NULL THEN start END, CASE WHEN cut IS NOT NULL THEN greatest(cut - 1, start) END
  FROM (SELECT *, CASE WHEN size >= {SOFT} AND last > start + 1 THEN last WHEN size >= {HARD} THEN i + 1 END AS cut
    FROM (SELECT z.doc_id, z.i, z.start, z.size + length(ls[z.i + 1]) + 1 AS size, CASE WHEN ends_with(ls[z.i + 1], '.') THEN z.i + 1 ELSE z.last END AS last FROM z JOIN l USING (doc_id) WHERE z.i < n))),
p AS (SELECT doc_id, a, b FROM z WHERE a IS NOT NULL UNION ALL SELECT doc_id, z.start, n - 1 FROM z JOIN l USING (doc_id) WHERE z.i = n AND z.start < n),
o AS (SELECT doc_id, a + 1 AS first_line, b + 1 AS last_line, regexp_replace(array_to_string(ls[a + 1 : b + 1], chr(10)), '\\n+$', '') AS part FROM p JOIN l USING (doc_id))
SELECT doc_id, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, length(part)::BIGINT AS chars, sha1(part) AS digest FROM o WHERE part <> ''"""


@query(BOUNDARY)
def chunk_boundary(t):
    """Documents over the hard limit, cut where a sentence ends a line: every part. Those without such a line, which are
    packed by lines alone, are ``chunk_lines``."""
    lines = F.split("text", "\n")
    ends = F.transform(F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("k"), x.alias("x"))), lambda p: F.endswith(p["x"], F.lit("."))), lambda p: (p["k"] + 1).cast("long"))
    docs = t.documents.withColumn("ends", ends).where((F.length("text") > HARD) & (F.size("ends") > 0))
    rows = docs.select("doc_id", F.inline(C.boundary_parts(F.col("text"), F.lit(1), F.col("ends"), SOFT, HARD)))
    return rows.select("doc_id", "first_line", "last_line", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("digest"))


@query("SELECT doc_id, rpad(substr(text, 1, 30), greatest(50, length(substr(text, 1, 30)))::INT, ' ') AS padded, length(CASE WHEN length(text) >= 50 THEN text ELSE text || chr(10) || repeat(' ', 50 - length(text)) END)::BIGINT AS n FROM documents")
def pad_text(t):
    return t.documents.select("doc_id", E.padded(F.substring("text", 1, 30)).alias("padded"), F.length(E.padded(F.col("text"), 50, on_new_line=True)).cast("long").alias("n"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS lines, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::BIGINT AS stripped FROM documents")
def line_counts(t):
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length(X.stripped(F.col("text"))).cast("long").alias("stripped"))
