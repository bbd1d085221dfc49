"""Tables of questions, event time, aliases, tables that ticks add to, links, and what can be repeated."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import FUNCTIONAL, Settings
from tidemark.operators import consolidation, providers, reports, router, skills
from tidemark.operators import episodes as E
from tidemark.operators import facts as K
from tidemark.operators import order, questions
from tidemark.operators.fact_table import SCHEMA, FactTable
from tidemark.plans import memory as M
from tidemark.sources import files
from tidemark.streaming import jobs, working

S = Settings()
NOW = 1_782_727_200_000
LOG = "tenant string, seq long, ts long, op string, subject string, predicate string, object string, confidence double, source string"
MENTIONS = "tenant string, name string, entity_type string, aliases array<string>, ts long, seq long"


# -- order ------------------------------------------------------------------------------------------


def test_positions(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "b", "b", "b", "b"]), r.choice([None, 1, 2, 3, 3]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int")
    got = order.numbered(df.repartition(7), ["v"], ["g"]).collect()
    for g in (None, "a", "b"):
        own = sorted((x for x in got if x.g == g), key=lambda x: x.position)
        assert [x.position for x in own] == list(range(1, len(own) + 1))
        values = [(x.v is not None, x.v or 0) for x in own]
        assert values == sorted(values) and len(own) == sum(x == g for x, _, _ in rows)
    whole = order.numbered(df, ["k"]).collect()
    assert {x.k: x.position for x in whole} == {k: k + 1 for k in range(500)}
    assert order.numbered(df.limit(0), ["k"], ["g"]).count() == 0


# -- questions --------------------------------------------------------------------------------------


def asked_table(spark, rows):
    return spark.createDataFrame(rows, "question long, q string, vector array<double>, tenant string, session_id string, from_ms long, until_ms long, min_salience double")


@pytest.fixture(scope="module")
def store(spark):
    r = random.Random(2)
    lists = [[r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)] for _ in range(40)]  # many ties
    kind = "tenant string, id string, created_at long, session_id string, content string, salience double, archived boolean, entity_refs array<string>"
    rows = [(r.choice("ab"), f"e{k}", NOW - r.randrange(10**9), r.choice(["s", "t", None]), f"w{k % 7} word{k % 3}", r.random(), k % 11 == 0, []) for k in range(300)]
    vectors = [(f"e{k}", lists[k % 40] if k % 50 else None) for k in range(300)]
    return spark.createDataFrame(rows, kind).cache(), spark.createDataFrame(vectors, "id string, vector array<double>").cache()


@pytest.mark.parametrize(("mode", "together"), [("post", 3), ("pre", 2_048)])
def test_searches_equal_those_of_one_question(spark, store, monkeypatch, mode, together):
    monkeypatch.setattr(questions, "TOGETHER", together)
    monkeypatch.setattr(questions, "STEP", 37)
    episodes, vectors = store
    small = Settings(knn_candidates=25)
    rows = [
        (1, "w1 word2", [1.0, 0.5, -1.0, 0.0], "a", None, None, None, None), (2, "w2", [0.5, 0.0, 1.0, 1.0], "b", "s", None, None, 0.3), (3, "", [1.0, 0.0, 0.0, 0.0], "a", None, None, None, None),
        (4, "w3", [0.0, 0.0, 0.0, 0.0], "a", None, None, None, None), (5, "w3", None, "a", None, None, None, None), (6, "w4", [1.0, 1.0], "a", None, None, None, None),
        (7, "w5 w6", [0.0, 1.0, 0.0, 1.0], "a", None, NOW - 6 * 10**8, NOW - 10**8, None), (8, "word1", [1.0, 0.5, -1.0, 0.0], "b", None, None, None, None), (9, "x" * 4_001, [1.0, 0.0, 0.0, 0.0], "a", None, None, None, None),
    ]
    found = questions.search_episodes(asked_table(spark, rows), episodes, vectors, NOW, small, 6, mode)
    got = {}
    for r in found.orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append((r.id, r.score))
    for number, q, vector, tenant, session, low, high, least in rows:
        if number in (3, 4, 5, 6, 9):
            assert number not in got
            continue
        window = None if low is None else (low, high)
        alone = E.search(episodes, vectors, None, vector, q, NOW, small, 6, mode, tenant=tenant, session_id=session, window=window, min_salience=least)
        assert got.get(number, []) == [(r.id, r.score) for r in alone.collect()]
    assert any(got.values())
    assert questions.search_episodes(asked_table(spark, []), episodes, vectors, NOW, small, 6, mode).count() == 0


def test_one_plan_for_all_questions(spark, store):
    """The plan has as many joins for two questions as for two hundred."""
    episodes, vectors = store

    def joins(n):
        rows = [(k, "w1", [1.0, 0.5, float(k), 0.0], "a", None, None, None, None) for k in range(n)]
        found = questions.search_episodes(asked_table(spark, rows), episodes, vectors, NOW, S, 5)
        return found._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(2) == joins(200)


def test_skills_of_many_questions(spark):
    known = spark.createDataFrame([("deploy_site", "puts the site online", 1), ("blue_paint", "paints Blue things", 2), ("a", "b", 3), ("x", "site and blue", 4)], "name string, desc string, position int")
    asked = asked_table(spark, [(1, "Deploy the SITE the", None, "a", None, None, None, None), (2, "blue", None, "a", None, None, None, None), (3, "zz", None, "a", None, None, None, None)])
    got = {}
    for r in questions.search_skills(asked, known, 2).orderBy("question", "rank").collect():
        got.setdefault(r.question, []).append((r.name, r.hits))
    assert got == {q: [(r.name, r.hits) for r in skills.search(known, text, 2).collect()] for q, text in ((1, "Deploy the SITE the"), (2, "blue"))}


def test_rejected_questions(spark):
    asked = asked_table(spark, [(1, None, None, "a", None, None, None, None), (2, "q", None, "a", None, None, None, 1.5), (3, "q", None, "a", None, None, None, 0.5)])
    assert {r.question: r.reject for r in questions.checked(asked, 5).collect()} == {1: "question length", 2: "salience", 3: None}
    for k in (0, 101):
        with pytest.raises(ValueError):
            questions.checked(asked, k)
        with pytest.raises(ValueError):
            skills.search(spark.createDataFrame([], "name string, desc string, position int"), "x", k)


def test_answers_equal_those_of_one_question(spark, sf_dir):
    own, vector = M.memory(spark, sf_dir), M.asked_vector(spark, sf_dir)
    texts = ["where are we with it", "how to use the blue economy", "history of my jobs", "what happened yesterday", "who is item 3", "le the vert"]
    asked = asked_table(spark, [(n, q, vector, "t1", "7", None, None, None) for n, q in enumerate(texts)])
    lines = {}
    for r in router.rendered_each(asked, router.answer_each(own, asked, M.NOW, M.SETTINGS, 5), 5).collect():
        lines.setdefault(r.question, set()).add((r.place, r.line))
    for n, q in enumerate(texts):
        alone = router.rendered(q, router.answer(own, q, vector, "t1", M.NOW, M.SETTINGS, "7", 5))
        assert lines[n] == {tuple(r) for r in alone.collect()}


# -- versions ---------------------------------------------------------------------------------------


def random_log(r, n, late=True):
    rows = []
    for seq in range(n):
        ts = r.randrange(50) if late else seq * 3
        rows.append((r.choice("ab"), seq, ts, r.choice(["assert"] * 4 + ["retract"]), r.choice(["u", "U", "v"]), r.choice(["works_at", "owns", "nope"]), r.choice(["x", "X", "y", "z"]), r.random(), f"e{seq}"))
    return rows


def folded(rows):
    """Versions by event time, one row after the other."""
    done, held = [], {}
    for tenant, seq, ts, op, s, p, o, confidence, source in sorted(rows, key=lambda x: (x[2], x[1])):
        if p not in ("works_at", "owns"):
            continue
        key = (tenant, s.lower(), p, "" if p in FUNCTIONAL else o.lower())
        now = held.get(key)
        if op == "retract":
            if now and now["object"].lower() == o.lower():
                now["until"] = ts
                done.append(held.pop(key))
            continue
        if now and now["object"].lower() == o.lower():
            now["confidence"] = max(now["confidence"], confidence)
            now["sources"] += [source] if source not in now["sources"] else []
            now["asserted"] += 1
            continue
        new = {"id": f"f{seq}", "tenant": tenant, "subject": s, "predicate": p, "object": o, "from": ts, "until": None, "confidence": confidence, "sources": [source], "by": None, "asserted": 1}
        if now:
            now["until"], now["by"] = ts, new["id"]
            done.append(now)
        held[key] = new
    return sorted((v["id"], v["tenant"], v["subject"], v["predicate"], v["object"], v["from"], v["until"], v["confidence"], tuple(v["sources"]), v["by"], v["asserted"]) for v in [*done, *held.values()])


def rows_of(facts):
    return sorted((r.id, r.tenant, r.subject, r.predicate, r.object, r.valid_from, r.valid_until, r.confidence, tuple(r.sources), r.superseded_by, r.asserted) for r in facts.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_late_rows_are_spliced(spark, seed):
    r = random.Random(seed)
    rows = random_log(r, 160)
    log = spark.createDataFrame(rows, LOG).cache()
    assert rows_of(K.versions(log, K.BY_TIME)) == folded(rows)
    have, cuts = K.versions(log.where("seq < 60"), K.BY_TIME), (60, 61, 100, 160)
    for low, high in zip(cuts, cuts[1:], strict=False):
        stale, fresh = K.splice(have, log.where(F.col("seq") < low), log.where((F.col("seq") >= low) & (F.col("seq") < high)))
        have = spark.createDataFrame(K.spliced(have, stale, fresh).collect(), SCHEMA)
        assert rows_of(have) == folded(rows[:high])


def test_a_late_row_splits_a_version(spark):
    def row(seq, ts, o, op="assert"):
        return ("a", seq, ts, op, "u", "works_at", o, 1.0, f"e{seq}")

    log = spark.createDataFrame([row(0, 10, "A"), row(1, 20, "A"), row(2, 30, "B")], LOG)
    have = K.versions(log, K.BY_TIME)
    assert [(r.object, r.valid_from, r.valid_until) for r in have.orderBy("valid_from").collect()] == [("A", 10, 30), ("B", 30, None)]
    stale, fresh = K.splice(have, log, spark.createDataFrame([row(3, 15, "C")], LOG))
    after = K.spliced(have, stale, fresh).orderBy("valid_from").collect()
    assert [(r.id, r.object, r.valid_from, r.valid_until, r.superseded_by) for r in after] == [("f0", "A", 10, 15, "f3"), ("f3", "C", 15, 20, "f1"), ("f1", "A", 20, 30, "f2"), ("f2", "B", 30, None, None)]


def test_fact_table(spark, tmp_path):
    rows = random_log(random.Random(7), 120, late=False)
    log = spark.createDataFrame(rows, LOG).cache()
    table = FactTable(spark, f"{tmp_path}/facts")
    assert table.last() == -1 and table.versions().count() == 0
    first, second, third = (log.where((F.col("seq") >= low) & (F.col("seq") < low + 40)) for low in (0, 40, 80))
    acted = table.add(first, NOW)
    assert acted.count() == sum(x[3] == "assert" and x[5] != "nope" for x in rows[:40])
    # a tick that dies after it has written what it closes, before the pointer moves
    files.committed(K.advance(table.open(), third).where("valid_until IS NOT NULL").select(*K.FACT), f"{tmp_path}/facts/closed", 1)
    assert rows_of(table.versions()) == folded(rows[:40])
    for _ in range(2):
        table.add(second, NOW, 1)
        assert table.last() == 1 and rows_of(table.versions()) == folded(rows[:80])
    with pytest.raises(ValueError):
        table.add(third, NOW, 5)
    table.add(third, NOW)
    assert rows_of(table.versions()) == folded(rows)
    files_read = K.advance(table.open(), third).inputFiles()
    assert any("/open/" in f for f in files_read) and not any("/closed/" in f for f in files_read)


def test_links_as_they_are(spark):
    n = 3_000
    links = [(f"c{k:06}", f"c{k + 1:06}" if k < n else None) for k in range(n + 1)]
    links += [("g1", "g2"), ("g2", "nowhere"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("a0", "r2"), ("self", "self"), ("alone", None)]
    got = {r.id: (r.chain, r.steps, r.state) for r in K.walk(spark.createDataFrame(links, "id string, superseded_by string")).collect()}
    assert got == {f"c{k:06}": (f"c{n:06}", n - k, "whole") for k in range(n + 1)} | {
        "g1": ("g2", 1, "gap"), "g2": ("g2", 0, "gap"), **{x: ("r1", None, "cycle") for x in ("r1", "r2", "r3", "a0")}, "self": ("self", None, "cycle"), "alone": ("alone", 0, "whole"),
    }
    assert K.walk(spark.createDataFrame([], "id string, superseded_by string")).count() == 0


# -- aliases ----------------------------------------------------------------------------------------


def test_aliases_by_the_time_of_the_row(spark):
    """A second name of a thing that is known makes a duplicate; one that turns up later doesn't rewrite earlier rows."""
    mentions = spark.createDataFrame([("t", "Google Inc", "org", ["Google", "GOOG"], 0, 0), ("t", "Tom Dupont", "person", ["Tom"], 0, 5), ("other", "Elsewhere", None, ["Tom"], 0, 0)], MENTIONS)
    said = [("t", 1, 1, "user", "Google Inc"), ("t", 2, 2, "user", " google"), ("t", 3, 3, "Tom", "Airbus"), ("t", 6, 6, "tom", "Airbus"), ("other", 7, 7, "Tom", ""), ("u", 8, 8, "Tom", "GOOG")]
    log = spark.createDataFrame([(t, n, ts, "assert", s, "works_at", o, 1.0, f"ep{n}") for t, n, ts, s, o in said], LOG)
    known = K.resolve_log(log, K.alias_history(mentions))
    assert {r.seq: (r.subject, r.object) for r in known.collect()} == {
        1: ("user", "Google Inc"), 2: ("user", "Google Inc"), 3: ("Tom", "Airbus"), 6: ("Tom Dupont", "Airbus"), 7: ("Elsewhere", ""), 8: ("Tom", "GOOG"),
    }
    assert {r.seq: r.action for r in K.actions(known).collect()} == {1: "inserted", 2: "duplicate", 3: "inserted", 6: "inserted", 7: "inserted", 8: "inserted"}
    assert K.resolve_log(log, K.alias_history(mentions.limit(0))).collect() == log.collect()


@pytest.mark.parametrize("seed", [3])
def test_aliases_against_a_fold(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.choice(["Ada", "ADA", "Bob", "Cy", "x1"]), None, [r.choice(["x1", "X2", "ada", ""])], 0, k * 2) for k in range(60)]
    told = [(r.choice("ab"), k * 2 + r.choice([0, 1]), 0, "assert", r.choice(["x1", "X2", "bob", "ADA", " cy "]), "owns", r.choice(["x2", "Ada"]), 1.0, f"e{k}") for k in range(60)]

    def called(tenant, name, seq):
        first = {}
        for t, n, _, _, _, s in rows:
            first.setdefault((t, n.lower()), n)
        names = {(0, first[t, n.lower()]) for t, n, _, _, _, s in rows if t == tenant and s <= seq and n.lower() == name.strip().lower()}
        others = {(1, first[t, n.lower()]) for t, n, _, a, _, s in rows if t == tenant and s <= seq and name.strip().lower() in (x.lower() for x in a if x)}
        return min(names | others)[1] if names | others else name

    got = {r.source: (r.subject, r.object) for r in K.resolve_log(spark.createDataFrame(told, LOG), K.alias_history(spark.createDataFrame(rows, MENTIONS))).collect()}
    assert got == {x[8]: (called(x[0], x[4], x[1]), called(x[0], x[6], x[1])) for x in told}


def test_a_run_resolves_names(spark):
    kind = "tenant string, id string, created_at long, session_id string, role string, content string, salience double, surprise double, arousal double, self_ref double, recurrence double, decay_state double, last_decayed_at long, consolidated_at long, extraction_failed boolean, archived boolean, entity_refs array<string>"
    old = NOW - 2 * S.consolidation_delay_ms
    rows = spark.createDataFrame([("t", str(k), old + k, "s", "user", text, 0.9, 0.5, 0.5, 0.5, 0.5, 1.0, None, None, False, False, []) for k, text in enumerate(["I works_at google.", "I works_at Google Inc."])], kind)
    known = K.upsert_entities(spark.createDataFrame([("t", "Google Inc", "org", ["Google"], 0, 0)], MENTIONS))

    class Facts(providers.Plain):
        def extract(self, text, subject):
            return json.dumps({"facts": json.loads(super().extract(text, subject))["facts"]})

    run = consolidation.run_once(rows, spark.createDataFrame([], LOG), NOW, S, Facts(), entities=known)
    assert [r.object for r in run.assertions.orderBy("seq").collect()] == ["Google Inc", "Google Inc"]
    report = run.report.first()
    assert (report.inserted, report.duplicate, report.candidates) == (1, 1, 2)


# -- what can be repeated ---------------------------------------------------------------------------


def test_commits_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    for _ in range(2):
        files.committed(rows, f"{tmp_path}/t", 3)
        files.append_raw(rows.selectExpr("id", "'score' AS kind", "text AS raw"), f"{tmp_path}/raw", "m", "p", 7)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and files.read_raw(spark, f"{tmp_path}/raw").count() == 2
    raw = spark.createDataFrame([("1", "t", "s", "user", "hi", NOW), ("2", "t", "s", "robot", "x", NOW)], "id string, tenant string, session_id string, role string, content string, created_at long")
    taken = E.taken_in(raw, lambda r: providers.embedded(r, "content", providers.Local()))
    for _ in range(2):
        (one,) = files.committed(taken, f"{tmp_path}/episodes", 0).collect()  # row, code and vector together
    assert spark.read.parquet(f"{tmp_path}/episodes").count() == 1 and len(one.vector) == 64 and len(one.code) == 8


def test_a_second_dump_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("1", True, NOW), ("2", False, NOW), ("3", True, NOW)], "id string, archived boolean, created_at long")
    for now in (NOW, NOW, NOW + 5):
        assert files.dump_archived(rows, f"{tmp_path}/d", now).count() == 1
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/d").collect()) == ["1", "3"]
    files.dump_archived(rows.unionAll(spark.createDataFrame([("9", True, NOW)], rows.schema)), f"{tmp_path}/d", NOW + 9)
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/d").collect()) == ["1", "3", "9"]


def test_one_dump_a_month(spark, tmp_path):
    rows = spark.createDataFrame([("1", True, NOW), ("2", False, NOW)], "id string, archived boolean, created_at long")
    day = 86_400_000
    assert jobs.dump_monthly(rows, f"{tmp_path}/d", f"{tmp_path}/mark", NOW).count() == 1
    assert jobs.dump_monthly(rows, f"{tmp_path}/d", f"{tmp_path}/mark", NOW + 1) is None
    assert jobs.dump_monthly(rows, f"{tmp_path}/d", f"{tmp_path}/mark", NOW + 3 * day) is not None
    assert jobs.dump_monthly(rows, f"{tmp_path}/d", f"{tmp_path}/mark", NOW + 4 * day) is None


def test_registry_is_saved(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({'b "x"': {"name": 'b "x"', "uses": 2, "desc": "é"}, "a": {"name": "a", "success_rate": 0.5}}))
    had = files.load_registry(spark, f"{tmp_path}/r.json")
    files.save_registry(had, f"{tmp_path}/out")
    assert files.load_registry(spark, f"{tmp_path}/out").collect() == had.collect() and had.count() == 2


def test_import_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k}", NOW - (k * 37) % 50) for k in range(50)], "id string, created_at long")
    files.export(rows, spark.createDataFrame([], "id string"), f"{tmp_path}/x")
    got = files.import_in_order(spark, f"{tmp_path}/x", "episode", "id: string, created_at: bigint").orderBy("position").collect()
    assert [(r.created_at, r.id) for r in got] == sorted((r.created_at, r.id) for r in rows.collect()) and [r.position for r in got] == list(range(1, 51))


# -- ticks and streams ------------------------------------------------------------------------------


def test_ticks_go_on_from_the_table(spark, tmp_path):
    kind = "tenant string, id string, created_at long, session_id string, role string, content string, salience double, surprise double, arousal double, self_ref double, recurrence double, decay_state double, last_decayed_at long, consolidated_at long, extraction_failed boolean, archived boolean, entity_refs array<string>"
    old = NOW - 2 * S.consolidation_delay_ms
    rows = spark.createDataFrame([("t", str(k), old + k, "s", "user", f"I works_at item {k}.", 0.9, 0.5, 0.5, 0.5, 0.5, 1.0, None, None, False, False, []) for k in range(3)], kind)
    table = FactTable(spark, f"{tmp_path}/facts")
    spark.createDataFrame([], LOG).write.parquet(f"{tmp_path}/log/batch=0")
    done: list[str] = []

    def tick(now_ms):
        log = spark.read.schema(LOG).parquet(f"{tmp_path}/log")
        left = rows.where(~F.col("id").isin(done))
        run = jobs.consolidation_tick(lambda: (left.limit(1), log, table.open()), lambda r: files.committed(r.assertions, f"{tmp_path}/log", 1 + len(done)), now_ms, S, f"{tmp_path}/status")
        table.add(run.assertions, now_ms)
        done.extend(r.id for r in run.outcomes.collect())

    for n in range(3):
        tick(NOW + n)
    assert sorted(done) == ["0", "1", "2"] and table.last() == 2
    history = table.versions().orderBy("seq").collect()
    assert len(history) == 3 and [r.valid_until is None for r in history] == [False, False, True] and history[0].superseded_by == history[1].id
    assert files.last_mark(spark, f"{tmp_path}/status").first().phase == "idle"


def test_a_timer_calls_the_tick(spark, tmp_path):
    calls = []
    query = jobs.ticking(spark, calls.append, f"{tmp_path}/c", "1 second", clock=lambda: NOW)
    for _ in range(60):
        if len(calls) > 1:
            break
        query.awaitTermination(1)
    query.stop()
    assert len(calls) > 1 and set(calls) == {NOW}


def test_history_over_batches_and_resets(spark, tmp_path):
    kind = "tenant string, session_id string, id string, role string, content string, created_at long, kind string"
    parts = [
        [("t", "s", "1", "user", "one", 1, "turn"), ("t", "s", "2", "user", "two", 2, "turn"), ("t", None, "n1", "user", "alone", 1, "turn")],
        [("t", "s", "3", "user", "three", 3, "turn"), ("t", "s", None, None, None, 4, "reset"), ("t", "s", "5", "user", "five", 5, "turn"), ("t", None, "n2", "user", "again", 2, "turn")],
        [("t", "s", "6", "user", "six", 6, None), ("u", "s", "7", "user", "seven", 7, "turn")],
    ]

    def feed(name, make, mode):
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}/in/part={n}")
            stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/{name}/in/part=*")
            query = jobs.keep_batches(make(stream), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/c", mode)
            query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}/out"), query

    rows, _ = feed("all", working.with_history, "append")
    assert {r.id: r.history for r in rows.collect()} == {"1": [], "2": ["one"], "3": ["one", "two"], "5": ["one", "two", "three"], "6": ["one", "two", "three", "five"], "7": [], "n1": [], "n2": ["alone"]}
    rows, query = feed("reset", lambda s: working.with_history(s, resets=True), "append")
    assert {r.id: r.history for r in rows.collect()} == {"1": [], "2": ["one"], "3": ["one", "two"], "5": [], "6": ["five"], "7": [], "n1": [], "n2": ["alone"]}
    assert jobs.progress(query)["rows"] == 2 and jobs.progress(query)["state"] == 3
    rows, _ = feed("items", working.last_items, "update")
    assert [r.id for r in rows.where("batch = 2 AND tenant = 't'").orderBy("position").collect()] == ["5", "6"]


def test_health_has_the_depth_of_the_queue(spark, sf_dir):
    episodes = M.episodes(spark, sf_dir)
    scores = episodes.where("NOT archived").orderBy("id").limit(10).select("id")
    left = jobs.backlog(episodes, scores)
    row = reports.health(episodes, M.facts(spark, sf_dir), NOW, S, left).first()
    assert row.queue_depth == episodes.where("NOT archived").count() - 10 == left.first().depth
    assert "queue_depth" not in reports.health(episodes, M.facts(spark, sf_dir), NOW, S).columns


# -- statistics -------------------------------------------------------------------------------------


def test_rates_go_on(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b"]), r.randrange(20), r.randrange(90), r.random() < 0.5) for _ in range(200)]

    def fold(own):
        rate, n = 1.0, 0
        for _, _, hit in sorted((s, h, h) for _, s, _, h in own):
            rate, n = int((rate * n + hit) / (n + 1) * 10_000 + 0.5) / 10_000, n + 1
        return rate, n

    uses = spark.createDataFrame(rows, "name string, seq long, ts long, success boolean").cache()
    whole = {x.name: (x.success_rate, x.uses, x.last_used_at) for x in skills.success_rates(uses).collect()}
    assert whole == {n: (*fold([x for x in rows if x[0] == n]), max(x[2] for x in rows if x[0] == n)) for n in "ab"}
    rates = None
    for low in (0, 7, 8, 15):
        high = {0: 7, 7: 8, 8: 15, 15: 20}[low]
        rates = spark.createDataFrame(skills.success_rates(uses.where((F.col("seq") >= low) & (F.col("seq") < high)), rates).collect(), "name string, success_rate double, uses long, last_used_at long")
    assert {x.name: (x.success_rate, x.uses, x.last_used_at) for x in rates.collect()} == whole
    assert {x.name: x.uses for x in skills.success_rates(uses.where("name = 'a'").limit(0), rates).collect()} == {n: whole[n][1] for n in "ab"}
