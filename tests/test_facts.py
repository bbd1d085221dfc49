"""Versioned facts: cases by hand, and random logs against a fold row by row."""

from __future__ import annotations

import random

import pytest

from tidemark.config import FUNCTIONAL
from tidemark.operators import facts as K

LOG = "tenant string, seq long, ts long, op string, subject string, predicate string, object string, confidence double, source string"


def made(spark, rows):
    """rows: (op, subject, predicate, object, confidence) in order, for tenant a."""
    return spark.createDataFrame([("a", k, 1000 * k, op, s, p, o, c, f"e{k}") for k, (op, s, p, o, c) in enumerate(rows)], LOG)


def fold(rows):
    """The same versions and actions, one row after the other."""
    facts, acts = [], {}
    for tenant, seq, ts, op, subject, predicate, obj, confidence, source in rows:
        mine = [f for f in facts if f["until"] is None and (f["tenant"], f["subject"].lower(), f["predicate"]) == (tenant, subject.lower(), predicate)]
        same = next((f for f in mine if f["object"].lower() == obj.lower()), None)
        if op == "retract":
            if same:
                same["until"] = ts
            continue
        if same:
            same["confidence"] = max(same["confidence"], confidence)
            if source not in same["sources"]:
                same["sources"].append(source)
            acts[seq] = "duplicate"
            continue
        new = {"tenant": tenant, "id": f"f{seq}", "subject": subject, "predicate": predicate, "object": obj, "from": ts, "until": None, "confidence": confidence, "sources": [source], "by": None}
        if predicate in FUNCTIONAL and mine:
            mine[0].update(until=ts, by=new["id"])
            acts[seq] = "superseded"
        else:
            acts[seq] = "inserted"
        facts.append(new)
    return {(f["id"], f["tenant"], f["subject"], f["predicate"], f["object"], f["from"], f["until"], f["confidence"], tuple(f["sources"]), f["by"]) for f in facts}, acts


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    r = random.Random(seed)
    rows = [
        (r.choice("ab"), k, 10 * k, "retract" if r.random() < 0.3 else "assert", r.choice(["X", "x", "y"]), r.choice(["works_at", "prefers", "owns"]),
         r.choice(["p", "P", "q", "s"]), round(r.random(), 2), f"e{r.randrange(40)}")
        for k in range(600)
    ]
    log = spark.createDataFrame(rows, LOG)
    expected, acts = fold(rows)
    got = {(f.id, f.tenant, f.subject, f.predicate, f.object, f.valid_from, f.valid_until, f.confidence, tuple(f.sources), f.superseded_by) for f in K.versions(log).collect()}
    assert got == expected
    assert {a.seq: a.action for a in K.actions(log).collect()} == acts
    assert K.duplicate_current(K.versions(log)).first()[0] == 0


def test_duplicate_keeps_spelling_and_start(spark):
    (row,) = K.versions(made(spark, [("assert", "u", "owns", "Bike", 0.7), ("assert", "U", "owns", "bike", 0.9)])).collect()
    assert (row.object, row.valid_from, row.confidence, row.sources, row.asserted) == ("Bike", 0, 0.9, ["e0", "e1"], 2)


def test_functional_supersedes_and_multi_coexists(spark):
    facts = K.versions(made(spark, [("assert", "u", "works_at", x, 1.0) for x in "ABA"] + [("assert", "u", "owns", x, 1.0) for x in "AB"]))
    jobs = facts.where("predicate = 'works_at'").orderBy("seq").collect()
    assert [(f.object, f.superseded_by) for f in jobs] == [("A", "f1"), ("B", "f2"), ("A", None)]
    assert K.current(facts, "a", "U", "owns").count() == 2
    chain = {c.id: (c.chain, c.steps) for c in K.chains(facts).collect()}
    assert chain == {"f2": ("f2", 0), "f1": ("f2", 1), "f0": ("f2", 2)}


def test_retraction(spark):
    facts = K.versions(made(spark, [("assert", "u", "owns", "A", 1.0), ("retract", "u", "owns", "B", 1.0), ("retract", "u", "owns", "a", 1.0), ("assert", "u", "owns", "A", 1.0)]))
    assert [(f.valid_until, f.superseded_by) for f in facts.orderBy("seq").collect()] == [(2000, None), (None, None)]
    assert K.as_of(facts, 2500).count() == 0 and K.as_of(facts, 500).count() == 1


def test_unknown_predicate_and_empty_log(spark):
    assert K.versions(made(spark, [("assert", "u", "loves", "A", 1.0)])).count() == 0
    assert K.versions(spark.createDataFrame([], LOG)).count() == 0


def test_aliases(spark):
    entities = spark.createDataFrame([("a", "Acme", ["AC", "shared"]), ("a", "Beta", ["shared", ""]), ("b", "Zed", ["ac"])], "tenant string, canonical_name string, aliases array<string>")
    names = spark.createDataFrame([("a", "acme"), ("a", " ac "), ("a", "SHARED"), ("a", "nobody"), ("a", " "), ("b", "AC"), ("a", None)], "tenant string, name string")
    got = {(r.tenant, r.name): r.canonical for r in K.resolve_names(names, entities).collect()}
    assert got == {("a", "acme"): "Acme", ("a", " ac "): "Acme", ("a", "SHARED"): "Acme", ("a", "nobody"): "nobody", ("a", " "): " ", ("b", "AC"): "Zed", ("a", None): None}


def test_upsert(spark):
    schema = "tenant string, name string, entity_type string, aliases array<string>, ts long, seq long"
    rows = [("a", "Acme", None, ["AC"], 5, 1), ("a", "ACME", "org", ["ac", "A-Corp", "acme"], 9, 2), ("b", "acme", None, None, 1, 3)]
    got = {r.tenant: r for r in K.upsert_entities(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].asDict() == {"tenant": "a", "canonical_name": "Acme", "entity_type": "org", "first_seen": 5, "last_seen": 9, "episode_count": 2, "aliases": ["AC", "A-Corp"]}
    assert got["b"].aliases == [] and got["b"].entity_type is None


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_give_what_the_whole_log_gives(spark, seed):
    """Batch by batch from open versions, with the versions and actions of the whole log."""
    r = random.Random(seed)
    rows = [
        (r.choice(["assert", "assert", "assert", "retract"]), r.choice(["U", "u", "V"]), r.choice(["works_at", "lives_in", "owns", "unheard_of"]), r.choice(["A", "a", "B", "c"]), r.random())
        for _ in range(120)
    ]
    log = made(spark, rows)
    cuts = sorted(r.sample(range(1, 119), 5))
    have, acts = K.versions(log.where("seq < 0")), []
    for low, high in zip([0, *cuts], [*cuts, 120], strict=True):
        batch = log.where(f"seq >= {low} AND seq < {high}")
        acts += K.batch_actions(have, batch).collect()
        rows_ = K.apply(have, K.advance(have, batch)).collect()
        have = spark.createDataFrame(rows_, have.schema)
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, K.versions(log).select(*K.FACT).collect()))
    assert sorted(map(tuple, acts)) == sorted(map(tuple, K.actions(log).collect()))
    assert K.advance(have, log.where("seq < 0")).count() == 0


def test_only_open_versions_of_touched_pairs_are_read(spark):
    before = K.versions(made(spark, [("assert", "u", "works_at", "A", 0.5), ("assert", "u", "owns", "x", 0.5), ("assert", "v", "works_at", "B", 0.5)]))
    batch = made(spark, [("assert", "U", "works_at", "C", 0.9)] * 4).where("seq = 3")
    assert {x.object for x in K.advance(before, batch).collect()} == {"A", "C"}
    assert {(x.id, x.valid_until, x.superseded_by) for x in K.apply(before, K.advance(before, batch)).collect()} == {("f0", 3000, "f3"), ("f1", None, None), ("f2", None, None), ("f3", None, None)}


def test_seeds(spark):
    refs = spark.createDataFrame([(0, "a", "u", "works_at", "A", None), (1, "a", "u", "works_at", "B", 0.4), (2, "a", "U", "works_at", "b", 0.9)], "ref_id long, tenant string, subject string, predicate string, object string, confidence double")
    log = K.seeds(refs, 100, 7)
    assert [(x.seq, x.ts, x.confidence, x.source) for x in log.orderBy("seq").collect()] == [(100, 7, 1.0, "seed_import"), (101, 7, 0.4, "seed_import"), (102, 7, 0.9, "seed_import")]
    assert {x.action: x.n for x in K.action_counts(K.batch_actions(K.versions(log.limit(0)), log)).collect()} == {"inserted": 1, "superseded": 1, "duplicate": 1}
    assert [(x.object, x.position) for x in K.listed(K.versions(log)).collect()] == [("B", 1)]
