"""The registered queries and the pipeline on the small tables."""

from __future__ import annotations

import collections
import hashlib
import json
import zlib
from array import array

import numpy as np
import pytest
from oracle import assert_same, views

import corpus_pipeline
from tidemark.llm import langid, pieces, queries, simhash

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_op2(spark, sf_dir):
    rows = views(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall()
    fps = {i: int.from_bytes(simhash.simhash(t)[0], "big") for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in fps}


@pytest.fixture(scope="module")
def tokenizer():
    """The vocabulary as a unigram model of the tokenizer's own library."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(pieces.default_path(), "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece, score in zip(model.pieces, pieces.load().scores, strict=True):
        piece.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_op4_op8_against_the_tokenizer(spark, sf_dir, tokenizer):
    """Every row of both queries: ids of whole texts from the library, scores as sums over them; n best from changes."""
    v, texts = pieces.load(), dict(views(sf_dir).sql("SELECT doc_id, text FROM documents").fetchall())
    ids = {i: tokenizer.encode(t or "", num_threads=1) for i, t in texts.items()}
    known, unknown = set(v.plain), {}

    def score(found, text):
        """A character without a piece costs once, however many bytes it has."""
        of_bytes = sum(k not in known for k in found)
        if of_bytes:
            single = {v.pieces[k] for k in v.plain if len(v.pieces[k]) == 1}
            unknown[text] = sum(c not in single for c in text.replace(" ", "▁"))
        return sum(v.scores[k] for k in found if k in known) + (unknown.get(text, 0) * v.unknown if of_bytes else 0)

    expected = {i: (len(x), score(x, texts[i])) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.score) for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()} == expected
    best = QUERIES["op8_sentencepiece"](spark, sf_dir).collect()
    assert len(best) == len(texts)
    for r in best:
        assert (r.n_pieces, r.score) == expected[r.doc_id] and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(array("i", ids[r.doc_id]).tobytes()).hexdigest()
        assert r.scores[0] == r.score and r.scores == sorted(r.scores, reverse=True)
        seen = set()
        for rank, changes in enumerate(json.loads(r.changes)):
            own = list(ids[r.doc_id])
            for c in sorted(changes, key=lambda c: -c["at"]):
                own[c["at"] : c["at"] + c["replaced"]] = c["ids"]
            assert (len(own), score(own, texts[r.doc_id])) == (r.n_best_pieces[rank], r.scores[rank]) and tokenizer.decode(own) == tokenizer.decode(ids[r.doc_id])
            seen.add(tuple(own))
        assert len(seen) == len(r.scores)


def test_op6_by_sets(spark):
    """The prediction of every row from sets of n-grams: no filters, no sample, no hashes of texts."""
    folder = "/root/testdata/sf0.001"
    rows = views(folder).sql("SELECT doc_id, text, lang FROM documents").fetchall()

    def grams(text):
        line = " " + "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text) + " "
        return [line[k : k + n] for n in (3, 4) for k in range(len(line) - n + 1) if " " not in line[k + 1 : k + n - 1]]

    counts = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and text:
            counts[lang].update(grams(text))
    kept = langid.Settings().grams
    assert all(len(c) <= kept for c in counts.values())  # so no choice among equally frequent ones matters
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, folder).collect()}
    close = 0
    for i, text, _ in rows:
        own = grams(text or "")
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        share = {lang: sum(g in c for g in own) / len(own) for lang, c in counts.items()}
        top = max(share.values())
        assert abs(got[i].score - share[got[i].lang_pred]) < 0.02  # what false positives leave after the correction
        assert share[got[i].lang_pred] >= top - 0.02
        close += sorted(share.values())[-2] > top - 0.02
    assert close < len(rows) / 10


def test_op10_op1_shapes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = QUERIES["op10_license_scan"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and found.count() == n
    assert QUERIES["op1_imatch"](spark, sf_dir).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_near_dedup_recall_of_the_radius(spark):
    """The candidates that fingerprints within the radius choose hold all pairs of similarity 0.8 or more of a table."""
    texts = [t for (t,) in views("/root/testdata/sf0.01").sql("SELECT text FROM documents WHERE text IS NOT NULL").fetchall()]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    radius = simhash.radius_for(0.8, 256)
    fps = [int.from_bytes(simhash.vote([s], 4)[0], "big") for s in sets]
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for h in s.tolist():
            holders[h].append(k)
    both = collections.Counter((a, b) for ks in holders.values() for n, a in enumerate(ks) for b in ks[n + 1 :] if len(ks) < 200)
    near = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and not np.array_equal(sets[a], sets[b])]
    assert len(near) >= 10
    assert sum((fps[a] ^ fps[b]).bit_count() <= radius for a, b in near) == len(near)


def test_op6_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(views(folder).sql("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op6_language_id"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "tokenize"]
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert kept.columns == columns and kept.count() >= 0.98 * docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.near_dedup(spark, kept, sf_dir)
    left = one.collect()
    assert one.columns == columns and len({texts[r.doc_id] for r in left}) == len(left)
    result = corpus_pipeline.run(spark, sf_dir)
    lattice = pieces.Lattice(pieces.load())
    rows = result.collect()
    assert rows and all(r.n_chars == len(r.text) and lattice.decode(r.ids) == r.text for r in rows)
    copies = result.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert copies <= 2


ODD = [
    (1, "one two three four five six seven", "en", "a", 5), (1, "one two three four five six seven", "en", "a", 5), (None, None, None, None, None), (2, "", "en", "a", 0),
    (3, None, "en", None, None), (None, "one two three four five six seven", None, "b", 1), (4, "word " * 30_000, "de", "a", 150_000), (5, "12 34", "en", "a", 5),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS fp", "2 AS n_units", "3 AS copies", "'y' AS lang_pred")
    names = docs.columns[:5]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.select(*names), sf_dir)
        assert out.columns == names
        out.collect()
    last = corpus_pipeline.tokenize(spark, docs, sf_dir)
    assert last.count() == len(rows)
    mine = docs.selectExpr("*", "'mine' AS lang_score", "'gone' AS removed", "-1 AS n_removed", "'b' AS score", "array('o') AS others", "9 AS size")
    own = {c: mine.schema[c].dataType.simpleString() for c in mine.columns[5:]}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mine, sf_dir)
        assert out.columns == mine.columns and {c: out.schema[c].dataType.simpleString() for c in own} == own
        for r in out.collect():  # values of columns that the operators name theirs
            assert (r.fp, r.n_units, r.copies, r.lang_pred, r.lang_score, r.removed, r.n_removed, r.score, r.others, r["size"]) == ("x", 2, 3, "y", "mine", "gone", -1, "b", ["o"], 9)
    assert langid.identify(docs, langid.train(docs)).count() == len(rows)
