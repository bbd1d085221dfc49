"""Merkle manifests, joins by shingle similarity and fill-in-the-middle, against plain versions of each."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle import views

from tidemark.llm import fim, imatch, licenses, merkle, ngrams, queries, revisits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ["'x' AS output", "'y' AS form", "7 AS n", "'z' AS leaf", "1 AS position", "'s' AS sides", "'r' AS root", "3 AS size", "'t' AS node", "5 AS component_id", "9 AS _order_part"]


def made(spark, rows):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", *CLASH)


ODD = [
    (1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (None, None, None, None, None), (2, "", "en", "a", 0),
    (3, None, "en", None, None), (None, "One two three  four five six SEVEN", None, "b", 1), (4, "wörd 🙂 " * 30_000, "de", "a", 210_000), (5, "<P>", "", "a", 3), (6, " \n", "en", "a", 2),
    (7, "a b", "en", "a", 3), (8, "A\tb", "fr", "a", 3), (9, "a b c", "fr", "a", 5), (2, "", "en", "b", 0),
]


# -- fill in the middle -----------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["a", "ab", "é🙂x", "<<P", "a<S" * 5, "x" * 200_001 + "ü" * 7, "\x00 "])
def test_rotations_round_trip(text):
    r = random.Random(len(text))
    n = len(text)
    for _ in range(40):
        a, b = sorted((r.randint(0, n), r.randint(0, n)))
        p, m, s = text[:a], text[a:b], text[b:]
        for form, expected in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            out = bytes(fim.transformed(text, form, a, b)).decode()
            assert out == expected and bytes(fim.restored(out, form)).decode() == text


def test_reversal_by_steps(monkeypatch):
    monkeypatch.setattr(fim, "STEP", 3)
    for n in range(30):
        for start in range(0, n, 4):
            x = np.arange(n, dtype=np.uint8)
            fim.reverse(x, start, n)
            assert x.tolist() == [*range(start), *range(n - 1, start - 1, -1)]
            for cut in range(start, n + 1):
                x = np.arange(n, dtype=np.uint8)
                fim.rotate(x, start, cut, n)
                assert x.tolist() == [*range(start), *range(cut, n), *range(start, cut)]


def test_fim_on_odd_rows(spark):
    docs = made(spark, ODD)
    got = fim.restore(fim.transform(docs)).collect()
    assert len(got) == len(ODD)
    assert collections.Counter((r.doc_id, r.restored) for r in got) == collections.Counter((i, t or "") for i, t, *_ in ODD)
    for r in got:
        plain = not r.restored or any(m in r.restored for m in ("<P>", "<S>", "<M>"))
        assert r.n == len(r.restored) and (r.form == "plain" or not plain) and (r.prefix_chars is None) == (r.form == "plain")
    again = {(r.doc_id, r.restored): r.output for r in fim.restore(fim.transform(docs.repartition(5))).collect()}
    assert all(again[r.doc_id, r.restored] == r.output for r in got)
    assert fim.restore(fim.transform(made(spark, []))).collect() == []
    named = docs.selectExpr("doc_id AS id", "text AS body", "'q' AS text", "'w' AS doc_id")
    assert fim.transform(named, id_col="id", text_col="body").count() == len(ODD)


def test_restore_keeps_other_columns(spark):
    rows = spark.createDataFrame([("psm", "<P>a<S>c<M>b", 1), ("spm", "<S>c<P>a<M>b", 2), ("plain", "<P>", 3), (None, None, 4)], "form string, output string, k int").selectExpr("*", "'x' AS restored")
    assert {r.k: r.restored for r in fim.restore(rows).collect()} == {1: "abc", 2: "abc", 3: "<P>", 4: ""}


# -- Merkle manifest --------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """The root of a list of nodes and each one's siblings, level by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, p in enumerate(at):
            other = p ^ 1
            proofs[k].append((p, nodes[other] if other < len(nodes) else None))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], proofs


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by lists."""

    def leaf(i, text, lang, source, n):
        return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))

    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        now = n + 1 if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups[lang].append((i is not None, i or 0, leaf(i, text, lang, source, n), leaf(i, text, lang, source, now), i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: (sorted(groups[g]), *climbed([x[2] for x in sorted(groups[g])])) for g in order}
    root, above = climbed([below[g][1] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        leaves, subroot, proofs = below[g]
        for (_, _, own, now, i), proof in zip(leaves, proofs, strict=True):
            whole = [*proof, *up]
            for p, other in whole:
                now = H(now) if other is None else H(now, other) if p % 2 == 0 else H(other, now)
            out.append((i, own, subroot, root, H(*(o for _, o in whole if o)), now, now == root))
    return sorted(out, key=repr)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(docs):
    return sorted((tuple(r[n] for n in NAMES) for r in merkle.verified(docs).collect()), key=repr)


@pytest.mark.parametrize("levels", [12, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SIZE", 1 << levels)
    r = random.Random(levels)
    for n in (1, 21):
        rows = [(r.choice([None, k, k, k // 3]), r.choice(["", None, "x" * k, "é"]), r.choice([None, "", "a", "é", "zz", "zz", "zz", "zz"]), r.choice([None, "s"]), r.choice([None, k])) for k in range(n)]
        assert manifest_rows(made(spark, rows)) == plain_manifest(rows)
    if levels == 2:
        assert manifest_rows(made(spark, ODD)) == plain_manifest(ODD)
        assert manifest_rows(made(spark, [])) == []


def test_witnesses_of_one_block():
    """Every number of leaves: appended one by one, against whole lists."""
    for n in range(1, 40):
        leaves = [H(str(k)) for k in range(n)]
        block = merkle.Block()
        for leaf in leaves:
            block.append(leaf.encode())
        root, proofs = climbed(leaves)
        assert block.close(None).decode() == root
        for leaf, sides, raw, proof in zip(leaves, block.sides, block.siblings, proofs, strict=True):
            assert [bytes(raw[k : k + 32]).hex() for k in range(0, len(raw), 32)] == [o for _, o in proof if o]
            assert merkle.folded(leaf.encode(), sides.decode(), bytes(raw)).decode() == root


def test_one_group_has_all_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "SIZE", 8)
    rows = [(k, str(k), "en", None, 1) for k in range(700)]
    assert manifest_rows(made(spark, rows)) == plain_manifest(rows)


# -- Jaccard join -----------------------------------------------------------------------------------


def shingles(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


def plain_join(rows, percent=85):
    """Counter of (doc_id, n_shingles, component_id), by trying every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders, root = collections.defaultdict(list), list(range(len(rows)))
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b in {b for x in s for b in holders[x] if b < a}:
            both = len(s & sets[b])
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return collections.Counter((i, len(s), i if not s else min(least[find(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def joined_rows(docs, **kw):
    return collections.Counter(tuple(r) for r in ngrams.jaccard_components(docs, **kw).collect())


def test_op12(spark):
    folder = "/root/testdata/sf0.01"
    rows = views(folder).sql("SELECT doc_id, text FROM documents").fetchall()
    expected = plain_join(rows)
    assert collections.Counter(tuple(r) for r in queries.op12_ngram_jaccard_join(spark, folder).collect()) == expected
    assert sum(i != c for i, _, c in expected) > 20


@pytest.mark.parametrize("seed", [1])
def test_near_copies_in_small_cells(spark, monkeypatch, seed):
    """Groups of near copies around the threshold, with common passages, in cells and counts of a few rows."""
    for name, value in (("CELL", 8), ("PARTNERS", 4), ("CHUNK", 500), ("RANGE", 64), ("FREQUENT", 300), ("LEAST", 2)):
        monkeypatch.setattr(ngrams, name, value)
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choices(words, k=40))
    rows = []
    for g in range(14):
        base = r.choices(words, k=r.choice([3, 5, 9, 30, 60, 120]))
        for _ in range(r.choice([2, 6, 40])):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = r.choice(words)
            if g % 3 == 0:
                text.insert(r.randrange(len(text)), passage)
            rows.append((r.randrange(10_000), " ".join(text)))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert joined_rows(docs) == plain_join(rows)
    assert joined_rows(docs, percent=60) == plain_join(rows, 60)


def test_join_on_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in ODD]
    assert joined_rows(made(spark, ODD)) == plain_join(rows)
    assert joined_rows(made(spark, [])) == collections.Counter()


def test_pairs_inside_a_component_are_not_compared(spark):
    """A hub and its copies become one component; what is left to compare doesn't grow with the square of the group."""
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        text = list(base)
        text[k % 150] = f"x{k}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = ngrams._marked(docs, 4, "doc_id", "text")
    order = spark.sparkContext.broadcast(ngrams.frequent(marked, 4))
    prefixes = marked.selectExpr("row_id AS id", "text").mapInArrow(ngrams._prefixes(order, 4, 85), "id long, size long, tokens array<long>")
    hits = ngrams._hits(prefixes, 85)
    near = ngrams._similar(ngrams._hub_pairs(hits, 85), marked.selectExpr("row_id AS id", "text"), 4, 85)
    assert near.count() >= 250
    assert ngrams._open_pairs(hits, ngrams.components(near), 85).count() < 1_000


def test_copies_with_too_many_edits_of_their_own_are_no_candidates(spark):
    """What is left of the original in many copies lets no pair through that the edits alone rule out."""
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 121):
        text = list(base)
        for at in (20, 60, 100)[: 1 if k > 110 else 3]:  # four shingles each
            text[at + k % 19] = f"x{k}-{at}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = ngrams._marked(docs, 4, "doc_id", "text")
    order = spark.sparkContext.broadcast(ngrams.frequent(marked, 4))
    prefixes = marked.selectExpr("row_id AS id", "text").mapInArrow(ngrams._prefixes(order, 4, 85), "id long, size long, tokens array<long>")
    hits = ngrams._hits(prefixes, 85)
    ids = {r.row_id: r.doc_id for r in marked.select("row_id", "doc_id").collect()}
    pairs = [(ids[r.hub], ids[r.other]) for r in ngrams._hub_pairs(hits, 85).collect()]
    assert all(i == 0 or i > 110 for pair in pairs for i in pair) and len(pairs) <= 10
    assert joined_rows(docs) == plain_join(rows)


# -- cases that earlier tests leave out -------------------------------------------------------------


def test_licenses_of_an_empty_table(spark):
    assert licenses.scan(made(spark, [])).collect() == []
    twice = licenses.scan(made(spark, [(1, "The MIT License", None, None, 1), (1, "The MIT License", None, None, 1), (None, "mit license " * 20_000, None, None, 1)])).collect()
    assert sorted((r.doc_id or 0, r.n_base, r.base_labels) for r in twice) == [(0, 20_000, "mit"), (1, 1, "mit"), (1, 1, "mit")]


def test_imatch_of_a_very_long_text(spark):
    long = "wörd und mehr " * 60_000
    got = {r.doc_id: r for r in imatch.fingerprint_edits(made(spark, [(1, "kurz", None, None, 4), (2, long, None, None, 1), (3, long, None, None, 1)])).collect()}
    half = len(long) // 2
    assert got[2].edited_sha256 == hashlib.sha256((long[: len(long) - half] + "kurz").encode()).hexdigest() and got[2].n_chars == len(long)
    assert got[3].edited_sha256 == hashlib.sha256((long[: len(long) - half] + long[:half]).encode()).hexdigest() and got[3].fingerprint == got[2].fingerprint


def test_revisits_of_a_hot_url_at_equal_times(spark):
    """One URL has all records, many of them at one time, before which and at which there are responses."""
    r = random.Random(4)
    rows = [(k, r.choice(["response", "revisit"]), "http://h/p", r.choice([5, 5, 5, 6, 7]), {"etag": r.choice("ab")}) for k in range(400)]
    table = spark.createDataFrame(rows, "record_id long, kind string, url string, captured_at long, headers map<string,string>")
    for blocks in (None, 1, 3):
        got = {x.record_id: (x.response_id, x.status) for x in revisits.resolve(table, blocks).collect()}
        for i, kind, _, at, headers in rows:
            if kind == "revisit":
                before = [x for x in rows if x[1] == "response" and x[3] < at]
                best = max(before, key=lambda x: (x[3], x[0]), default=None)
                assert got[i] == ((None, "no-response") if best is None else (best[0], "resolved" if best[4] == headers else "mismatch"))
