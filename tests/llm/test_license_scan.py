import random
import re

from tessera.llm.license_scan import BASE, COVERED, TEMPLATES, license_scan, parsed

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, templates=None):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, base, more, best = [], set(), set(), 0.0
    for phrase, label in BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, (key, t, before) in parsed(templates or TEMPLATES).items():
        for i in range(len(w)):
            if w[i : i + len(key)] == key:
                share = sum(0 <= i + j - before < len(w) and w[i + j - before] == x for j, x in enumerate(t)) / len(t)
                if share >= COVERED:
                    more.add(label)
                    best = max(best, share)
    best = 1.0 if places else best
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(best, 4)


def test_against_brute_force(spark):
    texts = [
        None, "", "...", "CC BY cc-by, cc by cc", "All rights reserved. ALL RIGHTS RESERVED all all rights reserved", "GNU General Public License version 3",
        "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "mit license", "Apache License, Version 2.0", "the generalé public license",
        "general public license general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of that thing",
        "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification, are permitted once",
        "K cc by", "你 cc by sa", "by cc by", "x " * 40_000 + "all rights reserved", "mozilla public license", "released into the public domain", "public license " * 2000,
    ]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(3, texts[3], "w")], "doc_id long, text string, words string")
    got = sorted(license_scan(docs).collect())
    assert [tuple(r)[1:] for r in got] == [brute(texts[r.doc_id]) for r in got] and len(got) == len(texts) + 1
    assert license_scan(docs.limit(0)).count() == 0


def test_many_templates(spark):
    """600 templates: the plan has them as constants, and every place is found."""
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    templates = {}
    for k in range(600):
        text = [r.choice(vocabulary[: r.choice([5, 300])]) for _ in range(r.randint(1, 12))]
        a = r.randrange(len(text))
        key = text[a : a + r.randint(1, 4)]
        templates[f"t{k}"] = (" ".join(key), " ".join(text))
    texts = [" ".join(r.choice([r.choice(vocabulary), "other", *r.choice(list(templates.values()))]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(license_scan(docs, templates).collect())
    assert [tuple(x)[1:] for x in got] == [brute(texts[x.doc_id], templates) for x in got] and len(got) == 60


def test_very_long_text(spark):
    text = "cc by " * 300_000 + "gnu general public license version 3"
    got = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.labels) == (600_006, 300_001, 0, 600_001, "cc-by,gpl,gpl-3")
