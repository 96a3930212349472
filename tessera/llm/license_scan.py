"""License scans (1), with DataFrame and SQL functions only: a positional rare-token index over licence templates.

The index has postings for every template: its words with their places. A pass over the files writes, for each, its words
with those that no template has left blank, a small table that all else reads. Of a file's licence words those with the
highest inverse document frequency are looked up: a word is, where a template has no rarer key word. Each hit gives a
template and a start, the hit's place less the word's in the template; the starts of a template's two rarest words are
intersected, so that most fall away, and the mandatory key phrase is verified word by word at those left. As the words
looked up are part of the phrase, none of its places is missed, whatever the frequencies are. A template that is longer
than its key phrase is compared at the same relative places, and has to agree in a share of its words.

The plan doesn't grow with the number of templates: postings, phrases and templates are constants in it. A file is a row
throughout; only the document frequencies of licence words, a row for each, come to the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import ascii_lower

#: A word: a run of 0-9, a-z and characters beyond ASCII, in the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: (key phrase, template).
TEMPLATES: dict[str, tuple[str, str]] = {
    "agpl": ("affero general public license", "affero general public license"),
    "apache-2.0": ("apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "cc-by-nc": ("cc by nc", "cc by nc"),
    "cc-by-sa": ("cc by sa", "cc by sa"),
    "cc0": ("cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    "creative-commons": ("creative commons attribution", "under a creative commons attribution"),
    "epl": ("eclipse public license", "eclipse public license"),
    "gpl-3": ("general public license version 3", "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("lesser general public license", "lesser general public license"),
    "mit": ("mit license", "under the mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "mpl-2.0": ("mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    "unlicense": ("released into the public domain", "this is free and unencumbered software released into the public domain"),
}
#: Share of a template's words that have to agree at their relative positions.
COVERED = 0.5


def document_frequencies(words: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all files each licence word stands, and how many files there are. words: of (words)."""
    some = words.select(F.explode(F.array_distinct(F.filter("words", lambda w: w != ""))).alias("word"))
    total = words.select(F.lit(None).cast("string").alias("word"))
    found = {r["word"]: r["n"] for r in some.unionByName(total).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return found, found.get(None, 0)


def postings(phrases: list[list[str]], frequency: dict[str, int], files: int) -> list[dict[str, list[dict[str, int]]]]:
    """Two tables of word -> (template, place): of each phrase's rarest word, and of its second rarest."""
    idf = {w: math.log((files + 1) / (frequency.get(w, 0) + 1)) for p in phrases for w in p}
    tables: list[dict[str, list[dict[str, int]]]] = [{}, {}]
    for t, phrase in enumerate(phrases):
        rare = sorted(dict.fromkeys(phrase), key=lambda w: (-idf[w], w))
        for table, word in zip(tables, (rare[0], rare[min(1, len(rare) - 1)]), strict=True):
            table.setdefault(word, []).extend({"t": t, "k": k} for k, w in enumerate(phrase) if w == word)
    return tables


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


#: A template and a start are one number, so that sets of them are hashed.
SHIFT = 1 << 32


def _starts(table: dict[str, list[dict[str, int]]]) -> Column:
    """template * SHIFT + start of all hits with a posting in the table, where the start isn't before the text."""
    held = _constant(table, "map<string,array<struct<t:int,k:int>>>")
    mine = F.filter("hits", lambda h: h["w"].isin(list(table)))
    fits = lambda h: F.filter(F.element_at(held, h["w"]), lambda p: p["k"] <= h["i"])
    return F.flatten(F.transform(mine, lambda h: F.transform(fits(h), lambda p: p["t"].cast("long") * SHIFT + h["i"] - p["k"])))


def parsed(templates: dict[str, tuple[str, str]]) -> dict[str, tuple[list[str], list[str], int]]:
    """Label: key phrase, template and the words of the template before the key phrase."""
    out = {}
    for label, (key, text) in templates.items():
        k, t = key.split(), text.split()
        before = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        out[label] = (k, t, before)
    return out


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None, covered: float = COVERED) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are the smallest and largest of their starts.
    labels has the base labels and those of templates whose key phrase stands in the text and whose words agree to the
    share covered; score is the largest such share (1 where a base phrase stands, 0 where nothing does). Null counts
    as the empty text. Repeated rows each give a row; an empty table gives none; other columns aren't looked at.
    """
    known = parsed(TEMPLATES if templates is None else templates)
    base = [(label, p.split(), p.split(), 0) for p, label in BASE.items()]
    rules = base + [(label, key, text, before) for label, (key, text, before) in known.items()]
    vocabulary = sorted({w for _, _, text, _ in rules for w in text})
    found = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"), 1)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(found, lambda w: F.when(w.isin(vocabulary), w).otherwise("")).alias("words"))
    words = common.written(words, "words")
    first, second = postings([key for _, key, _, _ in rules], *document_frequencies(words))
    rare = sorted({*first, *second})
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(rare))
    scan = words.select("doc_id", "words", hits.alias("hits"))
    scan = scan.select("doc_id", "words", F.array_intersect(_starts(first), _starts(second)).alias("starts"))
    keys, texts = (_constant([r[k] for r in rules], "array<array<string>>") for k in (1, 2))
    before, labels = _constant([r[3] for r in rules], "array<int>"), _constant([r[0] for r in rules], "array<string>")
    key = lambda c: F.get(keys, c["t"])
    split = F.transform("starts", lambda x: F.struct(F.floor(x / SHIFT).cast("int").alias("t"), (x % SHIFT).cast("int").alias("s")))
    stands = F.filter(split, lambda c: F.slice("words", c["s"] + 1, F.size(key(c))) == key(c))

    def share(c: Column) -> Column:
        same = F.transform(F.get(texts, c["t"]), lambda w, k: F.when(F.get("words", c["s"] - F.get(before, c["t"]) + k) == w, 1).otherwise(0))
        return F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.size(F.get(texts, c["t"])).cast("double")

    scan = scan.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", stands.alias("stands"))
    scored = F.transform("stands", lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), share(c).alias("share")))
    scan = scan.select("doc_id", "n_words", F.filter(scored, lambda c: (c["t"] < len(base)) | (c["share"] >= covered)).alias("fit"))
    places = F.transform(F.filter("fit", lambda c: c["t"] < len(base)), lambda c: c["s"])
    said = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda c: F.get(labels, c["t"])))), ",")
    return scan.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        said(F.filter("fit", lambda c: c["t"] < len(base))).alias("base_labels"), said(F.col("fit")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("fit", lambda c: c["share"])), F.lit(0.0)), 4).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for the same rows over the view documents, from the same phrases and templates."""

    def text_list(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    def places(p: list[str]) -> str:
        return f"list_filter(range(len(w)), lambda s: w[s + 1] = '{p[0]}' AND w[s + 1 : s + {len(p)}] = {text_list(p)})"

    known = parsed(TEMPLATES)
    cols = [f"{places(p.split())} AS b{k}" for k, p in enumerate(BASE)] + [f"{places(key)} AS t{k}" for k, (key, _, _) in enumerate(known.values())]
    shares = []
    for k, (_, t, before) in enumerate(known.values()):
        terms = " + ".join(f"CASE WHEN s + {j - before + 1} > 0 AND w[s + {j - before + 1}] = '{x}' THEN 1 ELSE 0 END" for j, x in enumerate(t))
        shares.append(f"coalesce(list_max(list_transform(t{k}, lambda s: ({terms}) / {len(t)}::DOUBLE)), 0) AS s{k}")
    found = [f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values())]
    more = [f"CASE WHEN s{k} >= {COVERED} THEN '{label}' END" for k, label in enumerate(known)]
    said = lambda xs: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))), ','), '')"
    best = ", ".join([f"CASE WHEN s{k} >= {COVERED} THEN s{k} ELSE 0 END" for k in range(len(known))] + ["0.0::DOUBLE", "CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE 0 END"])
    joined = " || ".join(f"b{k}" for k in range(len(BASE)))
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(cols)} FROM t),
q AS (SELECT *, {joined} AS places, {", ".join(shares)} FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  {said(found)} AS base_labels, {said(found + more)} AS labels, round(greatest({best}), 4) AS score FROM q
"""
