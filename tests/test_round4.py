"""Whole jobs and growth: tables of questions, the graph's items, top-k by pivots."""

from __future__ import annotations

import random

import numpy as np
import pytest
from oracle import views

from tidemark.llm import pivots
from tidemark.operators import questions, skills
from tidemark.plans import catalog


def test_ghosts_count_every_item(spark, sf_dir):
    """Items of all parts are entities, also every fourth."""
    got = {r.entity for r in catalog.queries()["graph_ghosts"](spark, sf_dir).collect()}
    numbers = {int(e.split()[1]) for e in got}
    items = {x for (x,) in views(sf_dir).sql("SELECT p_partkey // 3 FROM part WHERE p_partkey % 3 = 1").fetchall()}
    assert numbers <= items and any(n % 4 == 3 for n in numbers)


@pytest.mark.parametrize("common", [0, 40, 1_000_000])
def test_skills_of_classes_of_questions(spark, monkeypatch, common):
    """Questions with equal words are one class, and common words are ranked by sets; results are those of one question."""
    monkeypatch.setattr(questions, "COMMON", common)
    r = random.Random(4)
    names = ["blue", "ring", "bolt", "green", "brand", "small"]
    rows = [("_".join([*r.sample(names, 2), str(k)]), r.choice(names), k) for k in range(200)]
    known = spark.createDataFrame(rows, "name string, desc string, position int")
    texts = [" ".join(r.sample([*names, "none", "how", *(str(100 + r.randrange(99)) for _ in range(6))], 4)) for _ in range(12)]
    asked = spark.createDataFrame([(k, texts[k % 12] + " x" * (k % 3)) for k in range(60)], "question long, q string")
    got = {}
    for row in questions.search_skills(asked, known, 4).orderBy("question", "rank").collect():
        got.setdefault(row.question, []).append((row.name, row.hits))
    for n, text in enumerate(texts):
        alone = [(row.name, row.hits) for row in skills.search(known, text, 4).collect()]
        assert all(got.get(k, []) == alone for k in range(n, 60, 12))


def test_skills_do_not_grow_by_questions(spark):
    """Many questions with the same words make no more rows than one of them until the answers are dealt out."""
    known = spark.createDataFrame([(f"blue_{k}", "ring", k) for k in range(300)], "name string, desc string, position int")
    asked = spark.createDataFrame([(k, f"the blue ring {'x' * (k % 2)}") for k in range(500)], "question long, q string")
    found = questions.search_skills(asked, known, 5)
    assert found.count() == 2_500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # what is counted is counted for classes, before


def by_force(asked, held, k):
    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    return sorted((q, i, near) for q, a in asked for near, (_, i) in enumerate(sorted((-cosine(b, a), i) for i, b in held)[:k], 1))


@pytest.mark.parametrize("small", [True, False])
def test_nearest_in_many_cells(spark, monkeypatch, small):
    """Equal questions, equal vectors and ties give what each pair by itself gives, however rows are dealt to cells."""
    if small:
        for name, value in (("TOGETHER", 5), ("LEAST", 1), ("TILE", 2), ("SPAN", 9), ("STEP", 3)):
            monkeypatch.setattr(questions, name, value)
    r = random.Random(7)
    lists = [[r.choice([-1.0, 0.5, 1.0]) for _ in range(3)] for _ in range(25)]
    held = [(f"c{k}", lists[k % 25]) for k in range(70)]
    asked = [(k, lists[k % 11]) for k in range(40)]
    table = spark.createDataFrame([(q, "x", v) for q, v in asked], "question long, q string, vector array<double>")
    for named in (False, True):
        rows = spark.createDataFrame([(i, v, lists.index(v)) for i, v in held], "id string, vector array<double>, vec_id int")
        found = questions.nearest_each(questions.passed(table, 6), rows if named else rows.drop("vec_id"), 6)
        assert sorted((x.question, x.id, x.near) for x in found.collect()) == by_force(asked, held, 6)


def test_plan_does_not_grow_with_questions(spark, monkeypatch):
    """Neither questions nor passes over the candidates come to the driver as parts of a plan."""
    monkeypatch.setattr(questions, "TOGETHER", 4)
    rows = spark.createDataFrame([(f"c{k}", [1.0, float(k)]) for k in range(20)], "id string, vector array<double>")

    def size(n):
        asked = spark.createDataFrame([(k, "x", [float(k), 1.0]) for k in range(n)], "question long, q string, vector array<double>")
        return questions.nearest_each(questions.passed(asked, 3), rows, 3)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(3) == size(60)


def test_pivots_of_many_queries(monkeypatch):
    """Runs of candidates are skipped as wholes, and what is left gives each query's best."""
    monkeypatch.setattr(pivots, "RUN", 10)
    r = np.random.default_rng(2)
    x = np.repeat(r.integers(-60, 60, (40, 4)), 50, axis=0) + r.integers(-1, 2, (2000, 4))
    p, ids, q = x[::100].astype(float), r.permutation(2000), x[::20]
    far = pivots.distances(x.astype(float), p)
    floor = pivots.floors(ids[::20], q, ids[::100], x[::100], 5, np.float64)
    found = list(pivots.best_of_block(q, far[::20], ids, x, far, ids[::20], 5, np.float64, floor))
    assert len(found) == len(q)
    for n, (places, scores) in enumerate(found):
        expected = sorted((-int(q[n] @ y), int(i)) for y, i in zip(x, ids, strict=True) if i != ids[20 * n])[:5]
        assert [(-int(s), int(ids[k])) for k, s in zip(places, scores, strict=True)] == expected
