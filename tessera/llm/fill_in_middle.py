"""Fill-in-middle transformation (13): DuckDB inside mapInArrow.

Every Arrow batch is registered as a view of a DuckDB connection of the task, and one SQL statement cuts its texts into
units (regexp_extract_all), picks the places by sha256 of the id, puts the pieces together (list_slice, array_to_string)
and hands back Arrow; no row passes through Python. A second statement rebuilds the text from the output and the form
alone. Nothing is shuffled, a task holds a part of a batch at a time, and what a document turns into depends on its own
row only, so that a lost executor costs a repetition of its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: A unit: a run of ASCII letters, or any other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that are one DuckDB view; a longer text has a view of its own.
VIEW = 4 << 20

#: $seed, $plain (percent that stay as they are), $spm (percent of the others with the suffix first), $p, $s, $m.
CUT = f"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat($seed, ':', doc_id)) AS h FROM batch),
units AS (
  SELECT doc_id, text, regexp_extract_all(text, '{UNIT}') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed),
placed AS (
  SELECT doc_id, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, $p) OR contains(text, $s) OR contains(text, $m) OR h3 % 100 >= 100 - $plain THEN 'plain' WHEN h4 % 100 < $spm THEN 'spm' ELSE 'psm' END AS form
  FROM units),
cut AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(units, 1, a), ''), '') AS prefix, coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') AS middle,
    coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') AS suffix
  FROM placed),
made AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat($p, prefix, $s, suffix, $m, middle) ELSE concat($s, suffix, $p, prefix, $m, middle) END AS output
  FROM cut)
"""
#: The text of (form, output), from these two alone: marks stand in none of its pieces.
BACK = """CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN concat(output[length($p) + 1 : strpos(output, $s) - 1], output[strpos(output, $m) + length($m) :], output[strpos(output, $s) + length($s) : strpos(output, $m) - 1])
  ELSE concat(output[strpos(output, $p) + length($p) : strpos(output, $m) - 1], output[strpos(output, $m) + length($m) :], output[length($s) + 1 : strpos(output, $p) - 1]) END"""
TEXTS = f"{CUT} SELECT doc_id, n, form, prefix_chars, middle_chars, output FROM made"
DIGESTS = f"{CUT} SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({BACK}) AS restored_sha256 FROM made"
RESTORED = f"SELECT doc_id, {BACK} AS text FROM batch"


def views(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about VIEW bytes of column text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // VIEW
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def in_duckdb(rows: DataFrame, sql: str, schema: str, text: int, params: dict[str, str | int]) -> DataFrame:
    """The rows of a SELECT over every view "batch" of rows; each task has its own connection and one thread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        used = {k: v for k, v in params.items() if f"${k}" in sql}
        with duckdb.connect(config={"threads": 1}) as con:
            for batch in batches:
                for part in views(batch, text):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql, params=used).to_arrow_table().to_batches()
                    con.unregister("batch")

    return rows.mapInArrow(run, schema)


def checked(marks: tuple[str, str, str]) -> dict[str, str]:
    """The three marks; an error if one could be read where it wasn't written: none is empty, part of another, or begins
    as one of them ends."""
    for i, x in enumerate(marks):
        if not x or any(i != j and x in y for j, y in enumerate(marks)) or any(x[:k] == y[-k:] for y in marks for k in range(1, min(len(x), len(y)))):
            raise ValueError(f"marks that can't be told apart: {marks}")
    return dict(zip("psm", marks, strict=True))


def fill_in_middle(
    docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars and the output text; with digests,
    output_sha256 and restored_sha256 in its place, both as DuckDB computes them.

    A null text is the empty text, which is plain with n 0; so is a text that holds a mark (n as counted). A null id is
    hashed as no digits. Repeated rows each give the same row, an empty table gives none, texts of any length go whole,
    and other columns are not looked at.
    """
    out = "output_sha256 string, restored_sha256 string" if digests else "output string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    params = {"seed": seed, "plain": plain, "spm": spm} | checked(marks)
    return in_duckdb(rows, DIGESTS if digests else TEXTS, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {out}", 1, params)


def restored(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id and text of the rows (doc_id, form, output) that fill_in_middle has made."""
    rows = made.select(F.col("doc_id").cast("long"), "form", "output")
    return in_duckdb(rows, RESTORED, "doc_id long, text string", 2, checked(marks))


#: Written for whole tables and without the operator's steps: places are counted in characters.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us FROM d),
k AS (SELECT *, len(us) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(us) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(us) + 1) AS y FROM u),
c AS (SELECT *, coalesce(list_sum(list_transform(us[1 : least(x, y)], lambda t: length(t))), 0)::BIGINT AS pc, coalesce(list_sum(list_transform(us[1 : greatest(x, y)], lambda t: length(t))), 0)::BIGINT AS mc,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN pc END AS prefix_chars, CASE WHEN form <> 'plain' THEN mc - pc END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, pc) || '<S>' || substr(text, mc + 1) || '<M>' || substr(text, pc + 1, mc - pc)
    ELSE '<S>' || substr(text, mc + 1) || '<P>' || substr(text, 1, pc) || '<M>' || substr(text, pc + 1, mc - pc) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
