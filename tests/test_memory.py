"""Episodes, salience, extraction, questions, skills, graph, files and streams."""

from __future__ import annotations

import json
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.config import DAY_MS, Settings
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import consolidation, evaluation, extraction, graph, providers, router, salience, skills
from tidemark.operators import episodes as E
from tidemark.operators import facts as K
from tidemark.sources import files
from tidemark.streaming import jobs, working

NOW = 1_782_727_200_000
S = Settings()
EPISODE = (
    "id string, tenant string, created_at long, session_id string, role string, content string, salience double, surprise double, arousal double, self_ref double, "
    "recurrence double, decay_state double, last_decayed_at long, consolidated_at long, extraction_failed boolean, archived boolean, entity_refs array<string>"
)


def episodes(spark, *changes):
    base = {
        "tenant": "a", "created_at": NOW, "session_id": "s", "role": "user", "content": "hello", "salience": 0.5, "surprise": None, "arousal": None, "self_ref": None,
        "recurrence": None, "decay_state": 1.0, "last_decayed_at": None, "consolidated_at": None, "extraction_failed": False, "archived": False, "entity_refs": [],
    }
    names = [c.split()[0] for c in EPISODE.split(", ")]
    rows = [tuple((base | {"id": str(k)} | change)[n] for n in names) for k, change in enumerate(changes)]
    return spark.createDataFrame(rows, EPISODE)


def test_decay(spark):
    first = E.decay(episodes(spark, {}, {"salience": 0.9}, {"archived": True}), NOW + 10 * DAY_MS, S)
    got = {r.id: r.decay_state for r in first.collect()}
    assert got["0"] == pytest.approx(0.25) and got["1"] == pytest.approx(0.45) and got["2"] == 1.0
    assert E.decay(first, NOW + 10 * DAY_MS, S).where("id = '0'").first().decay_state == pytest.approx(0.25)
    assert E.decay(first, NOW + 99 * DAY_MS, S).where("id = '0'").first().decay_state == 0.0


def test_archive_boundaries(spark):
    old = NOW - 91 * DAY_MS
    rows = episodes(
        spark, {"decay_state": 0.05, "consolidated_at": 1}, {"decay_state": 0.1, "consolidated_at": 1}, {"created_at": old, "salience": 0.3}, {"created_at": old, "salience": 0.6},
        {"created_at": NOW - 90 * DAY_MS, "salience": 0.3}, {"decay_state": 0.0, "consolidated_at": 1, "archived": True},
    )
    assert [r.archive_rule for r in E.archive(rows, NOW, S).orderBy("id").collect()] == [1, None, 2, None, None, None]


def test_candidates_and_pending(spark):
    hour = S.consolidation_delay_ms
    rows = episodes(
        spark, {"salience": 0.8, "surprise": 0.1, "created_at": NOW - hour}, {"salience": 0.6, "surprise": 0.1, "created_at": NOW - hour}, {"salience": 0.9, "surprise": 0.1}, {"tenant": "b"}
    )
    assert [r.id for r in E.candidates(rows, NOW, S).collect()] == ["0"]
    assert {r.tenant: (r.unscored, r.ready, r.waiting) for r in E.pending_counts(rows, NOW, S).collect()} == {"a": (0, 1, 1), "b": (1, 0, 0)}
    assert [r.id for r in E.unscored(rows).collect()] == ["3"]


def test_filters(spark):
    rows = episodes(spark, {"salience": 0.4}, {"salience": 0.39}, {"session_id": None}, {"archived": True}, {"tenant": "b"}, {"created_at": NOW + 1})
    assert {r.id for r in E.matching(rows, "a", "s", (NOW, NOW), 0.4).collect()} == {"0"}
    assert {r.id for r in E.matching(rows, "a").collect()} == {"0", "1", "2", "5"}


def test_scores_and_outcomes(spark):
    rows = episodes(spark, {}, {})
    scores = spark.createDataFrame([("0", 0.1, 0.2, 0.3, 0.4, 0.9, 1), ("0", 0.5, 0.5, 0.5, 0.5, 0.7, 2)], "id string, surprise double, arousal double, self_ref double, recurrence double, salience double, at long")
    got = {r.id: (r.surprise, r.salience) for r in E.with_scores(rows, scores).collect()}
    assert got == {"0": (0.5, 0.7), "1": (None, 0.5)}
    assert [r.salience for r in E.shown(E.with_scores(rows, scores)).orderBy("id").collect()] == [0.7, None]


def test_salience(spark):
    raw = spark.createDataFrame([('{"surprise":0.2,"arousal":0.1,"self_ref":0.8,"recurrence":0.0}',), ("no",), ('{"surprise":2,"arousal":0,"self_ref":0,"recurrence":-1}',), (None,)], "raw string")
    assert [r.salience for r in salience.parse(raw).collect()] == [0.8, 0.5, 0.4, 0.5]
    assert spark.range(1).select(salience.clamp(F.lit(float("nan")))).first()[0] == 0.0


def test_codes(spark):
    one = spark.createDataFrame([("The cat, the DOG", 0), ("the cat dog", 3_600_000), ("the cat dog", 5 * 3_600_000)], "t string, ms long")
    for code in (V.sparse_code, V.sparse_code_blake):
        a, b, c = (r[0] for r in one.select(code(F.col("t"), F.col("ms"))).collect())
        assert a == b and a[:7] == c[:7] and a[7] != c[7] and len(a) == 8
    many = spark.createDataFrame([(" ".join(f"w{k}" for k in range(100)),)], "t string")
    assert many.select(F.size(X.tokenize(F.col("t")))).first()[0] == 64


def test_search_modes(spark):
    rows = episodes(spark, {"tenant": "b"}, {"tenant": "b"}, {"tenant": "a"}, {"tenant": "a", "archived": True})
    vectors = spark.createDataFrame([(str(k), [1.0, k / 10]) for k in range(4)], "id string, vector array<float>")
    codes = rows.select("id", V.sparse_code(F.col("content"), F.col("created_at")).alias("code"))
    two = Settings(knn_candidates=2)
    assert E.search(rows, vectors, codes, [1.0, 0.0], "hello", NOW, two, tenant="a").count() == 0
    assert [r.id for r in E.search(rows, vectors, codes, [1.0, 0.0], "hello", NOW, two, mode="pre", tenant="a").collect()] == ["2"]


def test_extraction(spark):
    raw = json.dumps({"facts": [{"subject": " I ", "predicate": "Works at", "object": "Acme", "confidence": 0.5}, {"subject": "I", "predicate": "zzz", "object": "q"}, {"subject": "", "predicate": "owns", "object": "x"}, {"subject": "I", "predicate": "owns", "object": "x", "confidence": 2}]})
    rows = spark.createDataFrame([("e", raw), ("f", "nope"), ("g", None), ("h", '{"facts": "none"}')], "id string, raw string")
    got = [(r.subject, r.predicate, r.object, r.confidence, r.mapped) for r in extraction.map_predicates(extraction.raw_facts(rows)).orderBy("position").collect()]
    assert got == [("I", "works_at", "Acme", 0.5, "near"), ("I", "has_attribute", "zzz: q", 1.0, "fallback")]


@pytest.mark.parametrize(
    ("question", "kind"),
    [
        ("Où en est le projet", "working"), ("comment configurer la sauvegarde", "procedural"), ("steps to restart", "procedural"), ("comment ma préférence a évolué ?", "semantic_history"),
        ("we used to meet", "semantic_history"), ("Quand ?", "episodic_temporal"), ("résume ce qu'on a dit hier", "working"), ("on a parlé de vélos", "episodic_fuzzy"),
        ("qui est Tom", "semantic_fact"), ("what does Ann like", "semantic_fact"), ("thier", "unknown"), ("", "unknown"),
    ],
)
def test_questions(spark, question, kind):
    assert router.classify(question) == kind
    assert spark.createDataFrame([(question,)], "q string").select(X.question_type(F.col("q"))).first()[0] == kind


def test_skills(spark):
    log = spark.createDataFrame([(1, "send_mail", "mails"), (2, "a-b", "x"), (3, "__", "x"), (4, "send_mail", "sends a mail"), (5, "été", "y")], "seq long, name string, desc string")
    registry = skills.register(log)
    assert {(r.name, r.desc, r.position) for r in registry.collect()} == {("send_mail", "sends a mail", 1), ("été", "y", 5)}
    assert [r.name for r in skills.search(registry, "send a MAIL to").collect()] == ["send_mail"]
    uses = spark.createDataFrame([("s", 1, 10, True), ("s", 2, 20, False), ("s", 3, 30, False)], "name string, seq long, ts long, success boolean")
    row = skills.success_rates(uses).first()
    assert (row.success_rate, row.uses, row.last_used_at) == (0.3333, 3, 30)


def test_graph(spark):
    log = spark.createDataFrame(
        [("a", 1, NOW, "assert", "Me", "works_at", "Acme", 0.875, "e"), ("a", 2, NOW + 1, "assert", "me", "works_at", "Beta", 0.9, "e"), ("a", 3, NOW, "assert", "Me", "prefers", "green tea", 1.0, "e")],
        "tenant string, seq long, ts long, op string, subject string, predicate string, object string, confidence double, source string",
    )
    known = spark.createDataFrame([("a", "acme", [], "org", 0), ("a", "Beta", [], None, 3), ("b", "Gamma", [], None, 1)], "tenant string, canonical_name string, aliases array<string>, entity_type string, episode_count long")
    settings = Settings(canonical_subjects={"a": "me"})
    facts = K.versions(log)
    nodes = {r.id: r for r in graph.nodes(facts, known, "a", settings).collect()}
    assert set(nodes) == {"acme", "Beta", "c:green tea"}
    assert (nodes["acme"].expired, nodes["acme"].tether, nodes["acme"].mentions, nodes["acme"].type) == (True, "Beta", 1, "organisation")
    edges = {r.id: r for r in graph.edges(facts, known, "a", settings).collect()}
    assert edges["f:f2"].asDict() == {"id": "f:f2", "predicate": "travaille chez", "object_id": "Beta", "type": "emploi", "since": "juin 2026", "detail": "confiance 90%"}
    assert [(r.value, r.entity, r.steps) for r in graph.edge_history(facts, known, "a", settings).collect()] == [("Acme", "acme", 1)]
    rows = episodes(spark, {"entity_refs": ["x", "BETA", "acme"], "content": "c" * 100}, {"tenant": "b"})
    (memory,) = graph.memories(rows, known, "a", settings).collect()
    assert (memory.anchor, memory.date, len(memory.label), memory.label[-1]) == ("Beta", "29 juin 2026", 90, "…")


def test_consolidation(spark):
    old = NOW - 2 * S.consolidation_delay_ms
    rows = episodes(spark, {"content": "I works_at Acme.", "created_at": old}, {"content": "noise", "created_at": old, "surprise": 0.1, "salience": 0.9}, {"content": "late"})
    log = spark.createDataFrame([], "tenant string, seq long, ts long, op string, subject string, predicate string, object string, confidence double, source string")

    class Keen(providers.Local):
        def score(self, text, history):
            return json.dumps({"surprise": 1, "arousal": 1, "self_ref": 1, "recurrence": 1})

    run = consolidation.run_once(rows, log, NOW, S, Keen())
    report = run.report.first()
    assert (report.rescored, report.candidates, report.failed, report.inserted, report.duplicate) == (2, 2, 0, 1, 0)
    assert [(r.subject, r.predicate, r.object) for r in run.assertions.collect()] == [("a", "works_at", "Acme")]
    assert {r.id for r in run.episodes.where("consolidated_at IS NOT NULL").collect()} == {"0", "1"}
    again = consolidation.run_once(rows, log, NOW, S, Keen())
    assert [tuple(r) for r in again.assertions.collect()] == [tuple(r) for r in run.assertions.collect()]


def test_model_is_asked_once(spark, tmp_path):
    """However often a run's results are read; an extraction that fails is tried twice and then marked."""

    class Counting(providers.Local):
        """Writes a file for each call, as calls come from several processes; texts that say fail give no JSON."""

        def __init__(self, folder):
            self.folder = folder

        def _called(self, kind):
            (pathlib.Path(self.folder) / f"{kind}-{uuid.uuid4().hex}").touch()

        def score(self, text, history):
            self._called("score")
            return json.dumps({"surprise": 1, "arousal": 1, "self_ref": 1, "recurrence": 1})

        def extract(self, text, subject):
            self._called("extract")
            return "sorry" if "fail" in text else super().extract(text, subject)

    old = NOW - 2 * S.consolidation_delay_ms
    rows = episodes(spark, {"content": "I works_at Acme.", "created_at": old}, {"content": "will fail", "created_at": old}, {"content": "I owns a cat", "created_at": old, "surprise": 0.1, "salience": 0.9})
    log = spark.createDataFrame([("a", 1, 5, "assert", "a", "works_at", "Old", 0.5, "e")], "tenant string, seq long, ts long, op string, subject string, predicate string, object string, confidence double, source string")
    run = consolidation.run_once(rows, log, NOW, S, Counting(str(tmp_path)))
    for table in (run.scores, run.outcomes, run.assertions, run.mentions, run.changed, run.episodes, run.report, run.report):
        table.collect()
    assert len(list(tmp_path.glob("score-*"))) == 2 and len(list(tmp_path.glob("extract-*"))) == 4
    assert {(r.id, r.failed) for r in run.outcomes.collect()} == {("0", False), ("1", True), ("2", False)}
    assert {r.id for r in run.episodes.where("extraction_failed AND consolidated_at IS NOT NULL").collect()} == {"1"}
    assert {(r.object, r.superseded_by) for r in run.changed.collect()} == {("Old", "f3"), ("Acme", None), ("a cat", None)} and run.report.first().superseded == 1
    assert run.raw.where("kind = 'extract'").count() == 3
    files.append_raw(run.raw, f"{tmp_path}/raw", "local", "p1")
    assert files.read_raw(spark, f"{tmp_path}/raw").where("kind = 'score' AND model = 'local'").count() == 2


def test_intake(spark):
    rows = spark.createDataFrame([("1", "a", "s", "user", "hello there", NOW), ("2", "a", "s", "robot", "x", NOW), ("3", "a", "s", "user", "", NOW)], "id string, tenant string, session_id string, role string, content string, created_at long")
    (one,) = E.taken_in(rows, lambda r: providers.embedded(r, "content", providers.Local())).collect()
    assert (one.id, one.salience, one.surprise, one.decay_state, one.archived, len(one.code), len(one.vector)) == ("1", 0.5, None, 1.0, False, 8, 64)
    assert one.vector == pytest.approx(providers.Local().embed(["hello there"])[0], abs=1e-6)


def test_vectors_are_kept_by_digest(spark):
    class Once(providers.Local):
        def embed(self, texts):
            assert "known" not in texts and len(set(texts)) == len(texts)
            return [[float(len(t)), 0.1] for t in texts]

    rows = spark.createDataFrame([("a", "new"), ("b", "known"), ("c", "new"), ("d", None)], "id string, content string")
    known = spark.createDataFrame([("known", [7.0, 0.5])], "t string, vector array<double>").select(providers.text_digest(F.col("t")).alias("digest"), "vector")
    got = {r.id: r.vector for r in providers.embedded(rows, "content", Once(), known).collect()}
    assert got == {"a": [3.0, pytest.approx(0.1)], "b": [7.0, 0.5], "c": [3.0, pytest.approx(0.1)], "d": None} and got["a"][1] != 0.1  # 32 bits


@pytest.mark.parametrize(("q", "k", "salience"), [("", 5, None), ("x" * 4001, 5, None), ("x", 0, None), ("x", 101, None), ("x", 5, 1.5), ("x", 5, -0.1)])
def test_parameters(q, k, salience):
    with pytest.raises(ValueError):
        E.checked(q, k, salience)
    E.checked("x" * 4000, 100, 1.0)


def test_replay_in_blocks(spark):
    rows = episodes(spark, *({"created_at": NOW + (k * 37) % 50, "content": f"c{k}", "tenant": "ab"[k % 7 == 0]} for k in range(60)))
    plain = rows.collect()
    for blocks in (2, 5, 40):
        for x in E.replay(rows, NOW, 5, blocks).collect():
            before = sorted((y.created_at, y.id, y.content) for y in plain if y.tenant == x.tenant and (y.created_at, y.id) < (x.created_at, x.id))
            assert x.history == [c for _, _, c in before[-5:]]
    assert E.replay(rows.limit(0), NOW).count() == 0


def test_worker_marks(spark, tmp_path):
    assert jobs.remaining_seconds([], 0, 4) is None and jobs.remaining_seconds([10, 20], 2, 6) == 60
    assert [jobs.dump_due(NOW, last) for last in (None, NOW - 40 * DAY_MS, NOW - DAY_MS)] == [True, True, False]
    files.mark(spark, f"{tmp_path}/status", "extracting", NOW, 1, 4, 30)
    files.mark(spark, f"{tmp_path}/status", "idle", NOW + 1)
    assert [tuple(r) for r in files.last_mark(spark, f"{tmp_path}/status").select("phase", "at_ms", "done").collect()] == [("idle", NOW + 1, 0)]
    files.reset(spark, {"notes": "id string"}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/notes").count() == 0 and files.last_mark(spark, f"{tmp_path}/status").count() == 1
    assert files.alive(spark.read.parquet(f"{tmp_path}/notes")) and not files.alive(spark.read.schema("id string").parquet(f"{tmp_path}/notes").where("raise_error('x') IS NULL").union(spark.range(1).selectExpr("raise_error('gone')")))


def test_references(spark, tmp_path):
    (tmp_path / "refs.jsonl").write_text('{"subject": "u", "predicate": "owns", "object": "x", "confidence": 0.5}\nnot json\n{"subject": "u", "predicate": "owns", "object": "y"}\n{"subject": "u"}\n')
    assert [(r.object, r.confidence, r.tenant) for r in files.read_references(spark, f"{tmp_path}/refs.jsonl", "t").orderBy("ref_id").collect()] == [("x", 0.5, "t"), ("y", None, "t")]


def test_evaluation(spark):
    refs = spark.createDataFrame([(1, "u", "owns", "red bike"), (2, "u", "lives_in", "Rome"), (3, "u", "loves", "tea")], "ref_id long, subject string, predicate string, object string")
    facts = spark.createDataFrame([(1, "the user", "has_attribute", "a red car"), (2, "U", "owns", "bike red one"), (3, "v", "lives_in", "Rome")], "position long, subject string, predicate string, object string")
    got = {r.ref_id: (r.position, r.score) for r in evaluation.fuzzy_matches(refs, facts).collect()}
    assert got == {1: (2, 1.0), 2: (None, None), 3: (None, None)}
    assert tuple(evaluation.recall(refs, facts).first()) == (1, 3)


def test_files(spark, tmp_path):
    rows = episodes(spark, {"archived": True, "entity_refs": ["é"]}, {})
    facts = spark.createDataFrame([("f1", "x")], "id string, object string")
    files.export(rows, facts, f"{tmp_path}/out")
    back = files.import_records(spark, f"{tmp_path}/out", "episode", EPISODE.replace(" ", ": ", 0))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert files.import_records(spark, f"{tmp_path}/out", "fact", "id string, object string").collect()[0].object == "x"
    assert files.dump_archived(rows, f"{tmp_path}/dump", NOW).count() == 1
    assert spark.read.json(f"{tmp_path}/dump").select("id", "month").collect()[0].asDict() == {"id": "0", "month": "2026-06"}
    files.backup({"episodes": rows}, f"{tmp_path}/backup", "s1")
    assert spark.read.parquet(f"{tmp_path}/backup/s1/episodes").count() == 2
    (tmp_path / "registry.json").write_text(json.dumps({"b": {"name": "b", "uses": 2}, "a": {"name": "a"}}))
    (tmp_path / "broken.json").write_text("[1")
    assert [(r.position, r.name) for r in files.load_registry(spark, f"{tmp_path}/registry.json").collect()] == [(0, "b"), (1, "a")]
    assert files.load_registry(spark, f"{tmp_path}/broken.json").count() == 0
    assert files.alive(rows) and not files.alive(rows.select(F.raise_error(F.lit("no"))))


def test_stream_keeps_last_items(spark, tmp_path):
    turns = episodes(spark, *({"created_at": NOW + k, "session_id": f"s{k % 2}"} for k in range(14)))
    turns.where("created_at < 1782727200008").write.parquet(f"{tmp_path}/in/a")
    def go():
        stream = spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/in/*")
        jobs.keep_batches(working.last_items(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        rows = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out/*")
        last = rows.where("session_id = 's0'").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("x")).orderBy(F.desc("batch")).first()
        return [i for _, i in last.x]
    assert go() == ["0", "2", "4", "6"]
    turns.where("created_at >= 1782727200008").write.parquet(f"{tmp_path}/in/b")
    assert go() == ["4", "6", "8", "10", "12"]


def test_score_stream(spark, tmp_path):
    rows = episodes(spark, {}, {})
    rows.write.parquet(f"{tmp_path}/in")
    jobs.score_stream(jobs.deduplicated(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/scores", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scores").where("salience BETWEEN 0 AND 1").count() == 2
