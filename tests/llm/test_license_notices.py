"""License notices in their usual line wrapping, side by side and in long lines."""

from __future__ import annotations

import random
import textwrap
import time

import pytest
from keelson.llm import licenses

LONG = {}
for _name, _text in licenses.TEMPLATES:
    LONG[_name] = max(LONG.get(_name, ""), _text, key=len)
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer."""
PROSE = "The cat sat on the mat and all of the dogs in the house went to sleep."


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sorted(licenses.license_scan(df).collect(), key=lambda r: r["doc_id"])
    return [[(s["license"], s["first_line"], s["last_line"]) for s in r["license_spans"]] for r in rows]


def test_wrapped_notices(spark):
    wrapped = [MIT, BSD, *[textwrap.fill(LONG[x], w) for x in ("apache-2.0", "gpl-3.0", "mit", "bsd-3-clause") for w in (40, 60, 76)]]
    names = ["mit", "bsd-3-clause", *[x for x in ("apache-2.0", "gpl-3.0", "mit", "bsd-3-clause") for _ in range(3)]]
    texts = [f"{PROSE}\n\n{x}\n\n{PROSE}\n{PROSE}" for x in wrapped]
    assert scan(spark, *texts) == [[(n, 3, 3 + x.count("\n"))] for n, x in zip(names, wrapped, strict=True)]


def test_notice_late_in_a_long_line(spark):
    words = " ".join(["word"] * 900)
    assert scan(spark, f"{words} copyright {words} {' '.join(MIT.split())} {words}") == [[("mit", 1, 1)]]


@pytest.mark.parametrize("between", ["\n", " ", "\n\n"])
def test_notices_side_by_side(spark, between):
    altered = LONG["apache-2.0"].replace("governing", "ruling")
    pairs = [("Released under the MIT License.", "Licensed under CC BY 4.0."), ("All rights reserved.", BSD.replace("retain", "keep")), ("All rights reserved.", altered), (altered, "All rights reserved.")]
    names = [["mit", "cc-by-4.0"], ["all-rights-reserved", "bsd-3-clause"], ["all-rights-reserved", "apache-2.0"], ["apache-2.0", "all-rights-reserved"]]
    assert [[x[0] for x in r] for r in scan(spark, *[between.join(x) for x in pairs])] == names


def test_all_templates_in_one_block(spark):
    got = scan(spark, "\n".join(text for _, text in licenses.TEMPLATES))[0]
    assert [x[0] for x in got] == [name for name, _ in licenses.TEMPLATES]


def mixture(rng, prose, altered):
    """Words with notices in them, each with a few words replaced, and the names of the notices."""
    words, names = [], []
    for _ in range(rng.randrange(1, 5)):
        words += rng.choices(prose, k=rng.randrange(0, 60))
        name, text = rng.choice(licenses.TEMPLATES)
        notice = licenses.words_of(text)
        for _ in range(rng.randrange(0, 1 + len(notice) // 12) if altered else 0):
            notice[rng.randrange(len(notice))] = rng.choice(prose)
        names.append(name)
        words += notice
    return words + rng.choices(prose, k=20), names


@pytest.mark.parametrize(("altered", "least"), [(False, 200), (True, 194)])
def test_random_mixtures_of_notices(altered, least):
    """Whole notices are all found; of altered ones a few differ in the very word that names the version."""
    rng, prose = random.Random(3), [f"w{i}" for i in range(500)]
    right = 0
    for _ in range(200):
        words, names = mixture(rng, prose, altered)
        right += [licenses.TEMPLATES[x[0]][0] for x in licenses.scan_words(words)] == names
    assert right >= least


def test_pieces_do_not_matter():
    """The findings of a long block are those of its notices one by one."""
    rng, prose = random.Random(4), [f"w{i}" for i in range(500)]
    words, want = [], []
    for _ in range(60):
        words += rng.choices(prose, k=rng.randrange(5, 200))
        name, text = rng.choice(licenses.TEMPLATES)
        want.append((name, len(words), len(words) + len(licenses.words_of(text))))
        words += licenses.words_of(text)
    assert [(licenses.TEMPLATES[i][0], a, b) for i, _, _, a, b in licenses.scan_words(words)] == want


def test_the_sizes_decide_what_is_compared(monkeypatch):
    """With other sizes other templates are compared, and notices are lost: the ranking is by compression."""
    rng, prose = random.Random(5), [f"w{i}" for i in range(500)]
    cases = [mixture(rng, prose, False) for _ in range(30)]
    compared, match = [], licenses._match
    monkeypatch.setattr(licenses, "_match", lambda words, low, high, template, counts: compared.append(len(template)) or match(words, low, high, template, counts))
    licenses._found.cache_clear()
    own = [licenses.scan_words(w) for w, _ in cases]
    by_size, compared[:] = list(compared), []
    sizes = licenses.gains
    monkeypatch.setattr(licenses, "gains", lambda words, templates: random.Random(len(words)).sample(sizes(words, templates), len(templates)))
    licenses._found.cache_clear()
    shuffled = [licenses.scan_words(w) for w, _ in cases]
    licenses._found.cache_clear()
    assert compared != by_size
    assert sum(a != b for a, b in zip(own, shuffled, strict=True)) > 10


@pytest.mark.parametrize("unit", ["All rights reserved.\n", " ".join(random.Random(1).choices(licenses.words_of(LONG["mit"]), k=400)) + "\n"])
def test_a_text_costs_its_length(unit):
    spent = []
    for size in (250_000, 1_000_000):
        text = (unit * (size // len(unit) + 1))[:size]
        licenses._found.cache_clear()
        began = time.perf_counter()
        for a, b in licenses.candidate_blocks(text):
            licenses.scan_words(licenses.words_of(text[a:b]))
        spent.append(time.perf_counter() - began)
    assert spent[1] < 8 * spent[0] + 1 and spent[1] < 30


def test_scan_takes_bytes_that_are_not_utf8(spark):
    df = spark.sql("select 1 as doc_id, cast(concat(cast('Released under the MIT License. ' as binary), unhex('FF')) as string) as text")
    assert [s["license"] for s in licenses.license_scan(df).first()["license_spans"]] == ["mit"]
