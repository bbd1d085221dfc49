"""Token counts and n-best segmentation, against the tokenizer itself and by enumeration."""

from __future__ import annotations

import pathlib
import random
import subprocess
import sys

import pytest

from tidemark.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["", "a", " a", "Hello  world", "naïve   café 漢字 ☃ end ", "line\nbreak\n\n x", "thntblereof " * 3, "\t\x00odd", "     ", "ünïcödé🙂"]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(pieces.load())


@pytest.fixture(scope="module")
def tokenizer():
    """The same vocabulary as a unigram model of the tokenizer's own library."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.default_path(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for piece, score in zip(model.pieces, pieces.load().scores, strict=True):
        piece.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("thereandofinglyaé. ,XQ", k=r.randint(1, 14))).strip() or "x" for _ in range(n)]


def test_counts_and_ids_equal_the_tokenizer(lattice, tokenizer):
    for text in [*words(1, 400), "Hello world", "the end of it", "the café", " \n x"]:
        ids, score, _ = lattice.encode(text)
        assert ids.tolist() == tokenizer.encode(text, num_threads=1), text
        assert lattice.count(text) == (len(ids), score)


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(lattice, text):
    ids, _, _ = lattice.encode(text)
    assert lattice.decode(ids) == text
    assert lattice.count(text)[0] == len(ids)


def every(lattice, unit):
    """All segmentations of a unit: (score, starts from the end, ids)."""
    ends = [[], *lattice._edges(unit)]

    def go(at):
        if at == 0:
            yield 0.0, (), ()
            return
        for start, score, ids in ends[at]:
            for s, starts, before in go(start):
                yield s + score, (start, *starts), before + ids

    return sorted(go(len(unit)), key=lambda x: (-x[0], x[1]))


def test_n_best_of_units(lattice):
    for unit in ["▁there", "▁andof", "▁a", "▁thing.", "ing", "▁éq", "\n", ""]:
        expected = [(s, ids) for s, _, ids in every(lattice, unit)]
        for n in (1, 3, 10, 500):
            assert [(score, tuple(ids)) for score, ids in lattice.n_best(unit, n)] == expected[:n]


def test_n_best_of_texts(lattice):
    for text in ["the and", "a a a", "there is", "x\nand", "q", ""]:
        totals = [0.0]
        for unit in lattice.split(text):
            totals = sorted((a + s for a in totals for s, _, _ in every(lattice, unit)), reverse=True)[:60]
        for n in (2, 4, 8):
            ids, _, ranked = lattice.encode(text, n)
            assert [r["score"] for r in ranked] == totals[: min(n, len(totals))]
            for r in ranked:
                own = ids.tolist()
                for c in sorted(r["changes"], key=lambda c: -c["at"]):
                    own[c["at"] : c["at"] + c["replaced"]] = c["ids"]
                assert len(own) == r["pieces"] and lattice.decode(own) == text
            assert len({str(r["changes"]) for r in ranked}) == len(ranked)


def test_n_best_scores_equal_the_tokenizer(lattice, tokenizer):
    for text in ["the and", "therein", "of the sea"]:
        theirs = tokenizer.nbest_encode_as_ids(text, 5)
        scores = [sum(lattice.vocabulary.scores[k] for k in ids) for ids in theirs]
        assert [r["score"] for r in lattice.encode(text, 5)[2]] == scores


def test_n_best_of_long_units(lattice, monkeypatch):
    for unit in ["▁there", "▁andof", "▁éq漢字", "漢", "▁thing☃."]:
        expected = [(score, tuple(ids)) for score, ids in lattice.n_best(unit, 12)]
        best, count = lattice._best(unit), lattice._count(unit)
        with monkeypatch.context() as m:
            m.setattr(pieces, "SHORT", 0)
            assert [(score, tuple(ids)) for score, ids in lattice.n_best(unit, 12)] == expected
            assert lattice._best(unit) == best and lattice._count(unit) == count


def test_remembers_a_bounded_number():
    table = pieces.Remembered(len, 3 * pieces.ENTRY)
    assert [table[x] for x in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1] and len(table) <= 3
    assert table["x" * 1000] == 1000 and "x" * 1000 not in table


def test_fractional_scores(tokenizer):
    """Sums are 32-bit floats, piece by piece, as in the tokenizer."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(tokenizer.serialized_model_proto())
    r = random.Random(3)
    for p in model.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -r.random() * 12 - 1 / 3
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    v = pieces.load()
    scores = tuple(p.score for p in model.pieces)
    ours = pieces.Lattice(pieces.Vocabulary(v.pieces, scores, v.plain, v.byte_ids, float(pieces.np.float32(min(scores[k] for k in v.plain) - 10))))
    for text in [*words(5, 200), "naïve 漢字", "x" * 700]:
        ids, score, _ = ours.encode(text)
        assert ids.tolist() == theirs.encode(text, num_threads=1), text
        assert ours.count(text) == (len(ids), score)


def test_tables(spark, lattice):
    rows = spark.createDataFrame([(1, "the end"), (None, None), (1, "the end"), (2, "")], "doc_id long, text string").selectExpr("*", "'mine' AS score", "0 AS ids", "1 AS n_tokens")
    n, score = lattice.count("the end")
    assert sorted(map(tuple, pieces.count_tokens(rows).collect()), key=repr) == sorted([(1, n, score), (None, 0, 0.0), (1, n, score), (2, 0, 0.0)], key=repr)
    found = pieces.encode(rows, 3)
    got = sorted(((r.doc_id, r.ids, r.n_pieces, r.round_trip) for r in found.collect()), key=repr)
    ids = lattice.encode("the end")[0].tolist()
    assert got == sorted([(1, ids, n, True), (None, [], 0, None), (1, ids, n, True), (2, [], 0, True)], key=repr)
    assert {r.decoded for r in pieces.decode(found.where("doc_id = 1")).collect()} == {"the end"}
    assert pieces.encode(rows.limit(0)).count() == 0 and pieces.count_tokens(rows.limit(0)).count() == 0


def test_very_long_text(lattice):
    text = "abc" * 50_000 + " " + "x\n" * 20_000
    ids, _, ranked = lattice.encode(text, 2)
    assert lattice.decode(ids) == text and lattice.count(text)[0] == len(ids) and len(ranked) == 2


def test_two_million_characters_without_a_space():
    """In a process of its own, which may not grow by more than 150 MB."""
    code = """
import random, resource
from tidemark.llm import pieces
lattice = pieces.Lattice(pieces.load())
text = "".join(random.Random(1).choices("thereandofinglyaé漢", k=2_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, score, ranked = lattice.encode(text, 4)
assert lattice.count(text) == (len(ids), score) and lattice.decode(ids) == text and len(ranked) == 4
lattice.forget()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    root = pathlib.Path(pieces.__file__).parents[2]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 150
