"""SimHash, I-Match and line dedup."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, imatch, simhash, units

DOCS = "doc_id long, text string, extra string, fp string, component_id long, size long"


def docs(spark, rows):
    """(doc_id, text) rows, with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", -1, 7) for i, t in rows], DOCS)


def fingerprint(text, width=3):
    """Bit by bit, from the definition."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c", "a  b\tc\x0bd\x1ce f É é", "x " * 500, "\n\n"])
def test_simhash(text):
    assert int.from_bytes(simhash.simhash(text)[0], "big") == fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(k * k) for k in range(500))
    whole = simhash.simhash(text, 3, 4)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.simhash(text, 3, 4) == whole


def components(items, linked):
    """The least item of each one's component, by trying every pair."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in items}


def test_links_of_random_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(150)]
    for _ in range(500):  # chains of flips
        x = r.choice(fps)
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    expected = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    distinct = spark.createDataFrame([(bytearray(x.to_bytes(8, "big")), 1) for x in fps], "fp binary, size long")
    found = {int.from_bytes(n.node, "big"): int.from_bytes(n.root, "big") for n in simhash.components(simhash.links(distinct, 2)).collect()}
    assert {x: found.get(x, x) for x in fps} == expected


def test_blocks_and_bands(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = random.Random(5)
    rows = {}
    for _ in range(40):
        base, size = r.getrandbits(256), r.randint(1, 400)
        for _ in range(6):
            x = base
            for _ in range(r.randint(0, 20)):
                x ^= 1 << r.randrange(256)
            rows[x] = max(1, int(size * r.uniform(0.8, 1.25)))
    def linked(a, b):
        return (a ^ b).bit_count() <= 30 and abs(np.floor(np.log(rows[a]) / -np.log(0.8) + 1e-9) - np.floor(np.log(rows[b]) / -np.log(0.8) + 1e-9)) <= 1
    expected = components(sorted(rows), linked)
    distinct = spark.createDataFrame([(bytearray(x.to_bytes(32, "big")), n) for x, n in rows.items()], "fp binary, size long")
    found = {int.from_bytes(n.node, "big"): int.from_bytes(n.root, "big") for n in simhash.components(simhash.links(distinct, 30, 4, 0.8)).collect()}
    assert {x: found.get(x, x) for x in rows} == expected


def test_links_hold_no_pairs():
    """3,000 near copies, all linked: 4.5 million pairs, of which a block holds a tile's."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(6)
    base = r.getrandbits(256)
    fps = [(base ^ (1 << r.randrange(256)) ^ (1 << r.randrange(256)) ^ (1 << r.randrange(256))).to_bytes(32, "big") for _ in range(4_000)]
    fps = sorted(set(fps))
    far = [bytes(255 - b for b in fps[0])]

    def batch(x, visiting):
        return pa.record_batch([pa.array([7] * len(x)), pa.array([visiting] * len(x)), pa.array(x, pa.binary())], ["cell", "visiting", "fp"])

    batches = [batch(fps[:3_000] + far, False), batch(fps[3_000:3_500], True), batch(fps[3_500:], True)]
    tracemalloc.start()
    out = list(simhash._links(47, 4)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    edges = [e for b in out for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert len(edges) == len(fps) - 1 and {x for e in edges for x in e} == set(fps)
    assert peak < 40e6


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} if w else set() for w in (a.split(), b.split()))
    return len(a & b) / len(a | b) if a | b else 1.0


def grouped(got):
    """The sets of ids that share a component."""
    out = {}
    for x in got.collect():
        out.setdefault(x.component_id, set()).add(x.doc_id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("shingles", [simhash.SHINGLES, 300])
def test_near_duplicates_by_jaccard(spark, monkeypatch, shingles):
    monkeypatch.setattr(simhash, "SHINGLES", shingles)
    r = random.Random(8)
    texts = {}
    for _ in range(12):
        words = [str(r.random()) for _ in range(r.choice([1, 7, 9, 60, 90, 150]))]
        for _ in range(9):  # about both sides of 0.8, in chains
            texts[len(texts)] = " ".join(words)
            for _ in range(max(1, round(len(words) / 5 * r.uniform(0.01, 0.15)))):
                words[r.randrange(len(words))] = str(r.random())
    every = [jaccard(texts[a], texts[b]) for a in texts for b in texts if a < b]
    assert sum(0.6 < x < 0.8 for x in every) > 10 and sum(0.8 <= x < 0.95 for x in every) > 10
    expected = components(sorted(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    got = simhash.near_duplicates(docs(spark, list(texts.items())))
    assert {x.doc_id: x.component_id for x in got.collect()} == expected


def test_repeated_lines_count_once(spark):
    r = random.Random(9)
    body, line = " ".join(str(r.random()) for _ in range(280)), " one line that is repeated often"
    other = body.replace(" ", " changed ", 1)
    rows = [(1, body + 5 * line), (2, body + 40 * line), (3, body + 400 * line), (7, other + 5 * line), (8, other + 90 * line), (9, line)]
    assert grouped(simhash.near_duplicates(docs(spark, rows))) == [[1, 2, 3, 7, 8], [9]]


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (5, 5)], "u long, v long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(found[k] == 0 for k in range(1, 301)) and found[901] == 900


def test_near_duplicates_edge_cases(spark):
    rows = [(5, "the same text of words"), (3, "the same text of words"), (None, "the same text of words"), (9, None), (8, ""), (7, " \n"), (None, "alone with no identity here"), (5, "the same text of words")]
    got = simhash.near_duplicates(docs(spark, rows), 3, None, 1, 2)
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == sorted([(5, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (None, None), (5, 3)], key=repr)
    assert simhash.near_duplicates(docs(spark, []), 3, None, 1, 2).count() == 0
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    r = random.Random(1)
    words = [str(r.random()) for _ in range(300)]
    changed = [*words]
    changed[150] = "other"
    rows = [(4, " ".join(words)), (2, " ".join(changed)), (1, " ".join(reversed(words))), (2, " ".join(changed)), (None, " ".join(words))]
    got = simhash.keep_one(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    assert sorted((x.doc_id for x in got.collect()), key=repr) == [1, 2, None]


def test_keep_one_of_each_group_with_repeated_ids(spark):
    r = random.Random(2)
    a, b, c = (" ".join(str(r.random()) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (4, c.upper()), (2, "z " + b), (5, None), (5, "alone")]
    got = simhash.keep_one(docs(spark, rows)).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted([(1, a), (2, b), (4, min(c, c.upper())), (5, None), (5, "alone")], key=repr)


def edited(rows):
    """(doc_id, sha256 of the edited text) in the order of the contract."""
    order = sorted(rows, key=lambda x: -x[0])
    out = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        out[i] = hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    return out


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "other words here"), (None, "a b c d e f"), (4, None), (5, "")], "doc_id long, text string")
    rows = rows.selectExpr("*", "doc_id AS row_id", "map('k', doc_id) AS m", "doc_id AS _turn", "doc_id AS node", "doc_id AS root", "doc_id AS n", "doc_id AS _", "doc_id AS row", "doc_id AS head")
    got = simhash.keep_one(rows)
    assert got.columns == rows.columns
    found = got.collect()
    assert sorted((x.doc_id for x in found), key=str) == [1, 3, 4, None]
    assert all({x.doc_id} == {x.row_id, x.m["k"], x._turn, x.node, x.root, x.n, x["_"], x.row, x.head} for x in found)


def signatures(texts, band):
    """Subset by subset and term by term, from the definition."""
    held = {i: set(re.findall(r"\w+", (t or "").lower())) for i, t in texts.items()}
    frequency = collections.Counter(w for ws in held.values() for w in ws)
    low, high = len(texts) * math.exp(-band.high), len(texts) * math.exp(-band.low)
    salts = [int(x) for x in np.random.default_rng(band.seed).integers(1, 2**63, len(band.rates), dtype=np.uint64)]
    lexicon = {xxhash.xxh64_intdigest(w) for w, n in frequency.items() if low <= n <= high}

    def mixed(x):
        x = x * 0x9FB21C651E98DF25 % 2**64
        x = (x ^ x >> 35) * 0x9FB21C651E98DF25 % 2**64
        return x ^ x >> 28

    def sign(text):
        own = {xxhash.xxh64_intdigest(w) for w in re.findall(r"\w+", (text or "").lower())}
        own = sorted(own & lexicon or own)
        out = []
        for s, (salt, rate) in enumerate(zip(salts, band.rates, strict=True)):
            kept = [t for t in own if mixed(t ^ salt) <= min(2**64 - 1, int(rate * 2**64))]
            out.append(xxhash.xxh64_digest(b"".join(t.to_bytes(8, "little") for t in kept), s)[:4] if kept else bytes(4))
        return out

    return sign


def alike(a, b):
    some = [x == y for x, y in zip(a, b, strict=True) if x != bytes(4) or y != bytes(4)]
    return sum(some) / len(some) if some else 1.0


@pytest.mark.parametrize("sampled", [1, 20])
def test_imatch(spark, monkeypatch, sampled):
    """Fingerprints and likeness against sets and loops."""
    monkeypatch.setattr(imatch, "SAMPLED", sampled)
    r = random.Random(2)
    vocabulary = [f"w{k}é" for k in range(300)]
    rows = [(k * 3, " ".join(r.choices(vocabulary, k=r.randint(0, 120)))) for k in range(40)]
    rows += [(200, None), (201, ""), (202, rows[5][1]), (500, "€uro " * 9)]
    got = {x.doc_id: x for x in imatch.fingerprint_edits(docs(spark, rows)).collect()}
    assert {i: x.edited_sha256 for i, x in got.items()} == edited(rows)
    sign, order = signatures(dict(rows), imatch.Band()), sorted(rows, key=lambda x: -x[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        own, other = sign(text), sign(text[: len(text) - half] + after[:half])
        assert (got[i].n_chars, got[i].fingerprint, got[i].edited_fingerprint) == (len(text), b"".join(own).hex(), b"".join(other).hex())
        assert (got[i].near_edited, got[i].near_next) == (alike(own, other), alike(own, sign(after)))
    assert got[15].fingerprint == got[202].fingerprint and got[200].fingerprint == got[201].fingerprint
    assert len({x.fingerprint for x in got.values()}) > 35
    assert np.mean([x.near_edited for x in got.values()]) > np.mean([x.near_next for x in got.values()])


def test_imatch_of_many_equal_ids(spark):
    """Rows without an id are cut into stretches like any others, and follow one another by hash."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN id END AS doc_id", "concat('text number ', id, ' of some') AS text")
    found = rows.selectExpr("coalesce(doc_id, -9223372036854775808) AS key", "xxhash64(text) AS tie", "text", "doc_id").toPandas()
    keyed = rows.selectExpr("coalesce(doc_id, -9223372036854775808) AS key", "xxhash64(text) AS tie")
    cuts = imatch._cuts(keyed)
    sizes = np.bincount(imatch.stretch_of(cuts, found["key"].to_numpy(), found["tie"].to_numpy()))
    assert len(sizes) > 30 and sizes.max() < 300
    texts = found.sort_values(["key", "tie"], ascending=False)["text"].tolist()
    expected = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest() for t, after in zip(texts, [*texts[1:], texts[0]], strict=True))
    assert sorted(x.edited_sha256 for x in imatch.fingerprint_edits(rows).select("edited_sha256").collect()) == expected


def test_imatch_edge_cases(spark):
    assert imatch.fingerprint_edits(docs(spark, [])).count() == 0
    (one,) = imatch.fingerprint_edits(docs(spark, [(1, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    rows = [(None, "x y"), (None, "z"), (1, "a b c"), (1, "a b c")]
    assert imatch.fingerprint_edits(docs(spark, rows)).count() == 4


def test_imatch_frequencies(spark):
    rows = docs(spark, [(1, "A b b"), (2, "a c"), (3, None)])
    got = {r.term: r.df for r in imatch.document_frequencies(rows).collect()}
    assert sorted(got.values()) == [1, 1, 2]


def passages_kept(rows, ends, least):
    """Unit by unit, from the definition; rows in order of id."""
    seen, out = set(), {}
    for i, text in rows:
        spans, at = [], 0
        for m in re.finditer(ends, text):
            spans.append((at, at := m.end()))
        spans += [(at, len(text))] * (at < len(text))
        words = [tuple(text[a:b].lower().split()) for a, b in spans]
        runs, run = [], []
        for span, unit in zip(spans, words, strict=True):
            if not unit or unit in seen:
                run.append((span, len(unit)))
            else:
                runs.append(run)
                run = []
            seen.add(unit)
        gone = [(r[0][0][0], r[-1][0][1]) for r in [*runs, run] if sum(n for _, n in r) >= least]
        out[i] = ("".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in gone)), gone)
    return out


@pytest.mark.parametrize(("unit", "ends", "least"), [("sentence", r"\n|[.!?][ \t\r]+", 9), ("line", r"\n", 9), ("paragraph", r"\n[ \t\r]*\n\s*", 4)])
def test_passages(spark, monkeypatch, unit, ends, least):
    monkeypatch.setattr(common, "OFTEN", 3)
    r = random.Random(4)
    pool = [" ".join(r.choices("abcdé", k=r.randint(1, 8))) for _ in range(25)] + ["  A b\tc d e ", "a B c d e", "", " "]
    rows = [(k, "".join(r.choice(pool) + r.choice([". ", "\n", "! \t", "\n \n", ".x", ""]) for _ in range(r.randint(0, 12)))) for k in range(80)]
    got = units.remove_repeats(docs(spark, rows), unit, least).collect()
    expected = passages_kept(rows, ends, least)
    assert {x.doc_id: (x.text, [(s.start, s.end) for s in x.removed]) for x in got} == expected
    assert sum(len(gone) for _, gone in expected.values()) > 2


def test_passages_inside_lines(spark):
    passage = " ".join(f"This is sentence number {k} of a passage." for k in range(8))
    rows = [(1, f"own start {passage} own end"), (2, f"Other words {passage} Other words.\nMore."), (3, "One short line.\nOther words."), (4, "One short line.")]
    got = {x.doc_id: x for x in units.remove_repeats(docs(spark, rows)).collect()}
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 7, 0, 0]
    assert got[2].text == "Other words This is sentence number 0 of a passage. Other words.\nMore."
    (span,) = got[2].removed
    assert rows[1][1][span.start : span.end] == passage[passage.index("This is sentence number 1") :] + " "


def test_passages_edge_cases(spark):
    same = "one two three four five"
    rows = [(1, None), (2, ""), (3, same), (3, same), (None, same), (None, same), (4, f"{same}\n{same}"), (5, "short\nshort"), (6, " \n\n ")]
    got = units.remove_repeats(docs(spark, rows), "line", 5)
    assert got.columns[:6] == docs(spark, rows).columns
    expected = [(1, None, 0), (2, "", 0), (3, same, 0), (3, "", 1), (None, "", 1), (None, "", 1), (4, "", 2), (5, "short\nshort", 0), (6, " \n\n ", 0)]
    assert sorted(((x.doc_id, x.text, x.n_removed) for x in got.collect()), key=repr) == sorted(expected, key=repr)
    assert units.remove_repeats(docs(spark, [])).count() == 0


def test_passages_keep_other_columns(spark):
    rows = docs(spark, [(1, "a b c"), (2, "a b c"), (None, "a b c")]).selectExpr("*", "doc_id AS row_id", "'h' AS held", "map('k', doc_id) AS row", "3 AS high", "doc_id AS _id", "5 AS n_removed")
    got = units.remove_repeats(rows, "line", 2)
    assert got.columns == [*(c for c in rows.columns if c != "n_removed"), "n_units", "n_removed", "removed"]
    assert all((x.row_id, x.held, x.row, x.high, x._id) == (x.doc_id, "h", {"k": x.doc_id}, 3, x.doc_id) for x in got.collect())


def test_many_null_ids(spark):
    rows = spark.range(100_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('text of ', id % 1000, ' and more words') AS text")
    got = units.remove_repeats(rows, "line", 3).groupBy("n_removed").count().collect()
    assert {x.n_removed: x["count"] for x in got} == {0: 1000, 1: 99_000}
