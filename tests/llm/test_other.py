"""Revisits, language, pivots, mixing and licenses."""

from __future__ import annotations

import math
import random
import re
import time
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, licenses, mixing, pivots, queries, revisits

RECORDS = "record_id long, kind string, url string, captured_at long, headers map<string,string>, status string, block int"


def records(spark, rows):
    return spark.createDataFrame([(*r, "own", 9) for r in rows], RECORDS)


def resolved(rows):
    """Record by record."""
    out = {}
    key = lambda u: u.split("#")[0].split("://")[1]
    for i, kind, url, at, headers in rows:
        if kind != "revisit" or url is None or at is None:
            continue
        before = [r for r in rows if r[1] == "response" and r[2] and r[3] is not None and key(r[2]) == key(url) and r[3] < at]
        if not before:
            out[i] = (None, "no-response", None)
            continue
        best = max(before, key=lambda r: (r[3], r[0]))
        old, new = best[4] or {}, headers or {}
        if "etag" in old and "etag" in new:
            status = "resolved" if old["etag"] == new["etag"].removeprefix("W/") else "mismatch"
        elif "last-modified" in old and "last-modified" in new:
            status = "resolved" if old["last-modified"] == new["last-modified"] else "mismatch"
        else:
            status = "unvalidated"
        merged = old | {k: v for k, v in new.items() if k in revisits.PERMITTED}
        out[i] = (best[0], status, None if status == "mismatch" else merged)
    return out


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_revisits(spark, blocks):
    r = random.Random(blocks)
    rows = []
    for k in range(300):
        headers = {n: r.choice("ab") for n in ("etag", "last-modified", "date", "set-cookie", "expires") if r.random() < 0.6}
        url = f"http://h{0 if r.random() < 0.4 else r.randrange(6)}/p{r.choice(['', '#x'])}"
        rows.append((k, r.choice(["response", "revisit", "metadata"]), url, r.randrange(80), headers or None))
    rows += [(1000, "revisit", None, 5, None), (1001, "revisit", "http://h0/p", None, None), (1002, None, "http://h0/p", 3, None)]
    got = {x.record_id: (x.response_id, x.status, x.headers) for x in revisits.resolve(records(spark, rows), blocks).collect()}
    assert got == resolved(rows)
    assert revisits.resolve(records(spark, [])).count() == 0


def test_revisits_with_a_stray_time(spark):
    """One record far from the others leaves the rest in blocks of like size."""
    rows = [(k, "revisit" if k % 2 else "response", f"http://h{k % 9}/p", k, {"etag": "a"}) for k in range(900)] + [(5000, "revisit", "http://h1/p", 10**15, {"etag": "a"})]
    made = records(spark, rows)
    sizes = [x["count"] for x in revisits._blocks(made.select("captured_at"), None).groupBy("block").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 90
    got = {x.record_id: (x.response_id, x.status, x.headers) for x in revisits.resolve(made).collect()}
    assert got == resolved(rows)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Example.COM:80/A/b/?b=2&utm_source=x&a=1#top", "example.com/A/b?a=1&b=2"), ("https://user@m.example.com/?ref=y", "m.example.com"),
        ("example.com/x", "example.com/x"), ("http://example.com:8080", "example.com:8080"), ("", ""), (None, None), ("http://a/b?reference=1", "a/b?reference=1"),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical_url(F.col("u"))).first()[0] == key


def test_language(spark):
    r = random.Random(1)
    parts = {"aa": ["la", "mo", "ri"], "bb": ["kt", "zu", "vö"], "cc": ["the", "ing", "of"]}
    def text(lang, n):
        return " ".join("".join(r.choices(parts[lang], k=r.randint(1, 4))).capitalize() for _ in range(n))
    rows = [(k, text(lang, r.randint(5, 60)), lang) for k, lang in enumerate(r.choices(list(parts), k=300))]
    train = spark.createDataFrame([*rows, (900, None, "aa"), (901, "zzz", None)], "doc_id long, text string, lang string")
    model = langid.train(train, langid.Settings(per_language=50, grams=300, bits=14))
    assert model.languages == ("aa", "bb", "cc") and (model.false_positive > 0).all()
    fresh = [(text(lang, 20), lang) for lang in r.choices(list(parts), k=200)]
    assert np.mean([langid.classify(t, model)[0] == lang for t, lang in fresh]) > 0.98
    for empty in (None, "", "123 ... \n", "٣"):
        assert langid.classify(empty, model) == ("und", 0.0)
    docs = spark.createDataFrame([(1, "la mori", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, lang_pred string, held_out string")
    got = langid.identify(docs, model)
    assert sorted(got.columns) == ["doc_id", "held_out", "lang_pred", "lang_score", "text"]
    assert {x.doc_id: x.lang_pred for x in got.collect()} == {1: "aa", 2: "und"}
    none = langid.train(train.limit(0))
    assert langid.classify("la", none) == ("und", 0.0) and langid.identify(docs.limit(0), none).count() == 0


def test_language_filters_find_every_gram(spark):
    """No false negatives: each learned n-gram's masks name its language."""
    rows = spark.createDataFrame([(1, "lamori tana", "aa"), (2, "ktzu vö", "bb")], "doc_id long, text string, lang string")
    model = langid.train(rows, langid.Settings(grams=1000, bits=12))
    for text, lang in (("lamori tana", 0), ("ktzu vö", 1)):
        for h in langid.grams(text):
            found = np.bitwise_and.reduce([model.masks[0][langid._places(h, 12, p)] for p in range(2)])
            assert (found >> lang & 1).all()


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "ab cdefg héllo wörld x yz"
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    for size in (3, 4, 7, 11):
        monkeypatch.setattr(langid, "SLICE", size)
        assert np.array_equal(np.sort(np.concatenate(list(langid.grams(text)))), whole), size


def by_force(rows, k):
    floors = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in floors:
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in floors if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 60)
    monkeypatch.setattr(pivots, "STEP", 16)
    r = np.random.default_rng(0)
    rows = [(k, [float(x) for x in r.normal(size=8)]) for k in range(200)]
    rows += [(200 + k, rows[k][1]) for k in range(40)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (None, [1.0]), (305, [0.5, 0.5]), (310, []), (315, [float("inf")])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, score int, block int")
    got = sorted(map(tuple, pivots.top_k(table, F.col("vec_id") % 5 == 0, 7).collect()))
    assert got == by_force(rows, 7)
    assert pivots.top_k(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = table.where("vec_id < 3")
    assert sorted(map(tuple, pivots.top_k(few, F.col("vec_id") % 5 == 0, 20).collect())) == by_force(rows[:3], 20)


def big(value):
    """Components whose integers are near a power of two."""
    r = np.random.default_rng(value.bit_length())
    rows = [(k, [float(x) / 64 for x in value + r.integers(-2000, 2000, 6) * (1 + value // 10**6)]) for k in range(150)]
    rows += [(150 + k, [-x for x in rows[k][1]]) for k in range(50)]
    return rows + [(200, [4294967297 / 64, 4194305 / 64]), (205, [4294967297 / 64, 4194303 / 64]), (210, [1e300] * 6), (211, [1e18, -1.0]), (215, [2.0**56, 0.3, 7.0]), (216, [1.7e308])]


@pytest.mark.parametrize("value", [2**20, 2**26, 2**32, 2**58, 2**62])
def test_pivots_of_large_components(spark, monkeypatch, value):
    monkeypatch.setattr(pivots, "BLOCK", 50)
    monkeypatch.setattr(pivots, "STEP", 16)
    monkeypatch.setattr(pivots, "POOL", 40)
    rows = big(value)
    got = sorted(map(tuple, pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 7).collect()))
    assert got == [(q, rank, i, min(max(s, -(2**63)), 2**63 - 1)) for q, rank, i, s in by_force(rows, 7)]


def test_pivots_of_long_vectors(spark, monkeypatch):
    """768 dimensions: blocks are bounded by bytes; rows that share an id but not their vector share one list."""
    monkeypatch.setattr(pivots, "BLOCK_BYTES", 60 * 768 * 8)
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=768)]) for k in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pivots.top_k(table, F.col("vec_id") % 5 == 0, 7).collect())) == by_force(rows, 7)
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 2.0]), (2, [1.0, 1.0])]
    got = sorted(map(tuple, pivots.top_k(spark.createDataFrame(twice, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 3).collect()))
    assert got == [(0, 1, 1, 3 * 4096), (0, 2, 1, 2 * 4096), (0, 3, 2, 4096)]


def test_pivot_blocks_are_balanced_and_skipped(spark, monkeypatch):
    """On clustered vectors a query visits few blocks; blocks are of like size and one lies in each partition."""
    monkeypatch.setattr(pivots, "BLOCK", 100)
    keys = pivots._keys(spark, 16)
    at = spark.createDataFrame([(k,) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(16))).collect()
    assert [x[0] for x in at] == list(range(16))
    r = np.random.default_rng(3)
    counts = r.integers(0, 40, (8, 30))
    layout = pivots._layout(counts, 12)
    sizes = np.bincount(layout.ravel(), counts.ravel(), 12)
    assert sizes.max() < 1.5 * sizes.mean() and (np.diff(layout.ravel()) >= 0).all()
    centers = r.normal(size=(8, 16))
    centers *= 6 / np.linalg.norm(centers, axis=1, keepdims=True)
    rows = [(k, [float(x) for x in centers[k % 8] + 0.01 * r.normal(size=16)]) for k in range(1600)]
    got = sorted(map(tuple, pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 7).collect()))
    assert got == by_force(rows, 7)


def test_pivot_bounds_stop_early(monkeypatch):
    """On clustered vectors most candidates are never evaluated."""
    monkeypatch.setattr(pivots, "STEP", 8)
    r = np.random.default_rng(1)
    centers = r.integers(-60, 60, (40, 4))
    x = np.repeat(centers, 50, axis=0) + r.integers(-1, 2, (2000, 4))
    p = x[::100].astype(float)
    seen = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal seen
            seen += len(self)
            return np.asarray(self) @ other

    x = x * np.rint(64 / np.linalg.norm(x, axis=1, keepdims=True).clip(1)).astype(int) // 1
    far = pivots.distances(x.astype(float), p)
    ids = np.arange(len(x))

    class Seen(np.ndarray):
        def astype(self, kind):
            return np.asarray(self).astype(kind).view(Counted)

    floor = pivots.floors(ids[:1], x[:1], ids[::100], x[::100], 5, np.float64)
    ((places, scores),) = list(pivots.best_of_block(x[:1], far[:1], ids, x.view(Seen), far, np.array([0]), 5, np.float64, floor))
    expected = sorted((-int(x[0] @ y), k) for k, y in enumerate(x) if k)[:5]
    assert [(-s, k) for k, s in zip(places.tolist(), scores.tolist(), strict=True)] == expected
    assert seen < 1500


def level(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """Targets by resharing the excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > most * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets(spark):
    for seed in range(4):
        r = random.Random(seed)
        sizes = {s: r.choice([0, 1, 10, 500, 9000]) for s in [None, "", "a", "b", "é", "Z", "zz"][: r.randint(1, 7)]}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {x.source: x.target for x in mixing.targets(rows).collect()}
        assert got == pytest.approx(level(sizes))


def test_mix(spark):
    r = random.Random(9)
    rows = [(k, " ".join(["w"] * r.randint(0, 30)), r.choice(["a", "a", "a", "b", None])) for k in range(900)] + [(None, None, "a"), (5, "same id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'z' AS target", "3 AS rate", "4 AS weight")
    planned = mixing.plan(docs).collect()
    assert len(planned) == len(rows)
    taken, target = defaultdict(int), {}
    for x in planned:
        assert x.size == len((x.text or "").split()) and x.copies <= 2
        taken[x.source] += x.size * x.copies
        target[x.source] = x.target
    assert all(taken[s] == pytest.approx(t, rel=0.1) for s, t in target.items())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in planned)
    assert sorted(map(tuple, mixed.collect()), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.plan(docs.limit(0)).count() == 0
    assert [x.copies for x in mixing.plan(docs.where("text IS NULL")).collect()] == [0]


def test_mix_of_equal_rows(spark):
    """Rows that share an id, and rows that are wholly alike, draw each for itself, however they are dealt."""
    rows = spark.range(300).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN id < 150 THEN 'one two three' ELSE concat('w ', id, ' x') END AS text", "'a' AS source")
    few, many = (mixing.plan(rows.repartition(n), total=1.4).groupBy("text").sum("copies").collect() for n in (1, 7))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))
    same, other = (sum(x[1] for x in few if (x[0] == "one two three") is k) for k in (True, False))
    assert same == pytest.approx(210, rel=0.1) and other == pytest.approx(210, rel=0.1)


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.range(50).selectExpr(
        "id AS doc_id", "concat('w ', id) AS text", "'a' AS source", "id AS _copy", "id AS size", "id AS rate", "id AS target", "id AS copies", "id AS _source", "map('k', id) AS row", "id AS key", "id AS number"
    )
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert got and all({x.doc_id} == {x._copy, x["size"], x.rate, x.target, x.copies, x._source, x.row["k"], x.key, x.number} for x in got)


def test_license_words_and_places(spark):
    text = "The MIT License, mit-LICENSE\nApache License apache license! GNU General (Public) License mit  license"
    rows = [(1, text), (2, None), (3, ""), (None, "no"), (1, text)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))).collect()
    one = next(x for x in got if x.doc_id == 1)
    tokens = __import__("re").findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    starts = [k for p, _ in licenses.BASE for k in range(len(tokens)) if tokens[k : k + len(p.split())] == p.split()]
    assert (one.n_words, one.n_base, one.first_word, one.last_word) == (len(tokens), len(starts), min(starts), max(starts))
    assert one.base_labels == "apache,gpl,mit" and len(got) == 5
    two = next(x for x in got if x.doc_id == 2)
    assert (two.n_words, two.n_base, two.first_word, two.last_word, two.base_labels, two.labels, two.score) == (0, 0, None, None, "", "", 0.0)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("released under the GNU GPL v3", "gpl-3"),
        ("GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1"), ("a 3-clause BSD license", "bsd-3-clause"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("he said mit freude, the apache helicopter", ""), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("CC BY-SA 3.0 and cc by 4.0", "cc-by-4.0,cc-by-sa-3.0"),
    ],
)
def test_license_rules(spark, text, labels):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == labels and (row.score > 0) == bool(labels)


SPDX_LINES = (
    "Apache-2.0 apache-2.0", "GPL-2.0-only gpl-2", "GPL-3.0-or-later gpl-3", "LGPL-2.1-only lgpl-2.1", "AGPL-3.0-only agpl-3", "GFDL-1.3 gfdl-1.3", "MPL-1.1 mpl-1.1", "EPL-2.0 epl-2.0",
    "CDDL-1.0 cddl-1.0", "CPL-1.0 cpl-1.0", "EUPL-1.2 eupl-1.2", "Artistic-2.0 artistic-2.0", "OSL-3.0 osl-3.0", "AFL-3.0 afl-3.0", "OFL-1.1 ofl-1.1", "LPPL-1.3c lppl-1.3",
    "PSF-2.0 psf-2", "Python-2.0 psf-2", "PHP-3.01 php-3.01", "ZPL-2.1 zpl-2.1", "CECILL-2.1 cecill-2.1", "MS-PL mspl", "MS-RL msrl", "BSL-1.0 bsl-1.0", "UPL-1.0 upl-1.0", "ISC isc",
    "Zlib zlib", "Unlicense unlicense", "WTFPL wtfpl", "BSD-4-Clause bsd-4-clause", "BSD-3-Clause bsd-3-clause", "BSD-2-Clause bsd-2-clause", "0BSD bsd", "MIT mit", "Expat expat", "CC0-1.0 cc0-1.0",
    "CC-BY-4.0 cc-by-4.0", "CC-BY-SA-4.0 cc-by-sa-4.0", "CC-BY-NC-3.0 cc-by-nc-3.0", "CC-BY-ND-4.0 cc-by-nd-4.0", "CC-BY-NC-SA-4.0 cc-by-nc-sa-4.0", "CC-BY-NC-ND-4.0 cc-by-nc-nd-4.0",
)


def test_license_spdx_of_each_family():
    every = licenses.rules()
    missed = {}
    for line in SPDX_LINES:
        name, label = line.split()
        found = {(r.label, r.trust) for _, _, r in licenses.detect(f"// spdx-license-identifier: {name.lower()}\n", every)}
        if found != {(label, 1.0)}:
            missed[name] = found
    assert not missed
    assert {f[0] for f in licenses.FAMILIES} <= {r for x in SPDX_LINES for r in (x.split()[1], x.split()[1].rpartition("-")[0])}


@pytest.mark.parametrize("gap", ["\n", "  ", "\r\n", "\n * ", "\n# ", "\n//", " \n\t// ", "\n-- ", " */\n/* ", "\t"])
@pytest.mark.parametrize(
    ("phrase", "label"),
    [
        ("redistribution and use in source and binary forms, with or without modification", "bsd"), ("mozilla public license version 2.0", "mpl-2.0"), ("gnu lesser general public license version 2.1", "lgpl-2.1"),
        ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc"), ("licensed under the mit/x11 license", "mit"), ("spdx-license-identifier: mit", "mit"),
    ],
)
def test_license_wrapped(gap, phrase, label):
    every = licenses.rules()
    for k, c in enumerate(phrase):
        if c == " ":
            text = f"é  x\n\n {phrase[:k]}{gap}{phrase[k + 1 :]}.\n\n  end"
            (found,) = licenses.detect(text, every)
            assert (text[found[0] : found[1]], found[2].label) == (f"{phrase[:k]}{gap}{phrase[k + 1 :]}", label)
    assert len(licenses.detect("gpl\n\n2. terms", every)) == 0


NOTICES = (
    ("you may not use this file except in compliance with the license.", "apache"), ("permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu general public license as published by the free software foundation, either version 3 of the license", "gpl-3"),
    ("this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license, v. 2.0", "mpl-2.0"), ("redistributions of source code must retain the above copyright notice", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ('the software is provided "as is", without warranty of any kind', "mit"), ('the software is provided "as is" and the author disclaims all warranties', "isc"),
    ("the origin of this software must not be misrepresented", "zlib"), ("to the extent possible under law, the author has waived all copyright", "cc0-1.0"),
    ("it is released into the public domain", "public-domain"), ("this file is proprietary and confidential", "proprietary"),
)


@pytest.mark.parametrize(("text", "label"), NOTICES)
def test_license_notices(text, label):
    assert {r.label for _, _, r in licenses.detect(text, licenses.rules())} == {label}


def test_many_license_lines_take_linear_time():
    text = "licensed under the mit license. " * 20_000
    began = time.process_time()
    assert len(licenses.detect(text, licenses.rules())) == 20_000
    assert time.process_time() - began < 10


def pairwise(text, every):
    """Suppression by its definition, pair by pair, over all detections of the rules without their keywords."""
    view, places, ahead = licenses.unwrapped(text)
    original = lambda at: at + ahead[np.searchsorted(places, at, side="right") - 1]
    found = {(original(m.start()), original(m.end() - 1) + 1, r.label, r.priority, r.trust) for r in every for m in r.pattern.finditer(view)}
    order = lambda x: (x[0], -x[1], -x[3], x[2])
    over = lambda y, x: y[0] <= x[0] and y[1] >= x[1] and y[3] >= x[3] and order(y) < order(x)
    return sorted((x for x in found if not any(over(y, x) for y in found)), key=order)


def test_license_query_by_brute_force(spark, sf_dir):
    """Words, places, labels and score of every row, from their definitions."""
    every, seen = licenses.rules(), 0
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for x in queries.op10_license_scan(spark, sf_dir).collect():
        text = texts[x.doc_id].translate(lower)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        base = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        found = pairwise(text, every)
        labels = {label for _, label in base} | {f[2] for f in found}
        score = max([0.5 * bool(base), *(f[4] for f in found)])
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert (x.base_labels, x.labels, x.score) == (",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score)
        seen += bool(labels)
    assert seen > 5


def test_license_suppression():
    every = licenses.rules()
    assert len(every) > 200
    found = licenses.detect("the gnu lesser general public license, version 2.1 or the mit license", every)
    assert [r.label for _, _, r in found] == ["lgpl-2.1", "mit"]
