"""Queries over streams, batches and ticks: each gives what the whole table gives, and SQL says what that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DAY_MS
from ..operators import consolidation, providers, skills
from ..operators import facts as K
from ..operators.fact_table import FactTable
from ..sources import adapters as A
from ..sources.scratch import scratch_path, written
from ..streaming import jobs, working
from . import memory as M
from .memory import NOW, SETTINGS, query

# -- streams ----------------------------------------------------------------------------------------

_PARTS = ("turn_ < 2", "turn_ BETWEEN 2 AND 3", "turn_ > 3")


def _in_parts(spark: SparkSession, rows: DataFrame, parts, to: str, run) -> None:
    """Feeds rows to a stream part by part, ending and starting it again between them."""
    for n, part in enumerate(parts):
        rows.where(part).write.parquet(f"{to}/in/part={n}")
        run(spark.readStream.schema(rows.schema).parquet(f"{to}/in/part=*"))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as they come in: those of a session in three parts."""
    turn = (F.col("id").cast("long") % 1000).alias("turn_")
    return M.episodes(spark, folder).select("tenant", "session_id", "id", "role", "content", "created_at", turn)


@query(f"""
WITH {M._EPISODES}
SELECT id, coalesce(string_agg(content, '|') OVER (PARTITION BY tenant, session_id ORDER BY created_at, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM episodes
""")
def stream_scoring_history(spark: SparkSession, folder: str) -> DataFrame:
    """The history that each turn is scored by, of a stream that comes in three parts and starts again between them."""
    to = scratch_path(spark, "history")

    def run(stream: DataFrame) -> None:
        jobs.keep_batches(working.with_history(stream), f"{to}/out", f"{to}/checkpoint", "append").awaitTermination()

    _in_parts(spark, _turns(spark, folder), _PARTS, to, run)
    kept = spark.read.schema(T._parse_datatype_string(working.HISTORY + ", batch int")).parquet(f"{to}/out")
    return kept.select("id", F.array_join("history", "|").alias("history"))


@query(f"""
WITH {M._EPISODES}, h AS (
  SELECT *, count(*) OVER (PARTITION BY tenant, session_id ORDER BY created_at, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM episodes
), s AS (
  SELECT id, created_at, ('0x' || substr(md5(content), 1, 2))::INTEGER / 256e0 AS surprise, ('0x' || substr(md5(content), 3, 2))::INTEGER / 256e0 AS arousal,
    ('0x' || substr(md5(content), 5, 2))::INTEGER / 256e0 AS self_ref, n / 8e0 AS recurrence FROM h
)
SELECT id, round(greatest(0.4e0 * surprise + 0.3e0 * self_ref + 0.2e0 * arousal + 0.1e0 * recurrence, self_ref), 6) AS salience, recurrence FROM s
""")
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score log of the same stream, by a provider whose scores depend on text and history."""
    to = scratch_path(spark, "scores")

    def run(stream: DataFrame) -> None:
        jobs.score_stream(stream, f"{to}/out", f"{to}/checkpoint", providers.Plain()).awaitTermination()

    _in_parts(spark, _turns(spark, folder), _PARTS, to, run)
    return spark.read.parquet(f"{to}/out").select("id", F.round("salience", 6).alias("salience"), "recurrence")


@query(f"""
WITH {M._EPISODES}, reset AS (SELECT tenant, session_id FROM episodes WHERE CAST(session_id AS BIGINT) % 4 = 0 AND CAST(id AS BIGINT) % 1000 = 2),
left_ AS (SELECT * FROM episodes e WHERE CAST(id AS BIGINT) % 1000 > 2 OR NOT EXISTS (SELECT 1 FROM reset x WHERE x.tenant = e.tenant AND x.session_id = e.session_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant, session_id ORDER BY created_at DESC, id DESC) AS back, count(*) OVER (PARTITION BY tenant, session_id) AS n FROM left_)
SELECT tenant, session_id, id, role, (least(n, 5) - back + 1)::INTEGER AS position FROM r WHERE back <= 5
""")
def stream_session_resets(spark: SparkSession, folder: str) -> DataFrame:
    """Working memory of a stream in which every fourth session is reset after its third turn."""
    to, turns = scratch_path(spark, "resets"), _turns(spark, folder).withColumn("kind", F.lit("turn"))
    third = (F.col("turn_") == 2) & (F.col("session_id").cast("long") % 4 == 0)
    resets = turns.where(third).withColumns({"kind": F.lit("reset"), "id": F.lit(None).cast("string"), "content": F.lit(None).cast("string"), "created_at": F.col("created_at") + 1})

    def run(stream: DataFrame) -> None:
        jobs.keep_batches(working.last_items(stream), f"{to}/out", f"{to}/checkpoint").awaitTermination()

    _in_parts(spark, turns.unionByName(resets), _PARTS, to, run)
    kept = spark.read.schema(T._parse_datatype_string(working.OUT + ", batch int")).parquet(f"{to}/out")
    # a session whose last batch left nothing has no rows there: its turns all came before its reset
    told = turns.unionByName(resets).withColumn("batch", F.when(F.col("turn_") < 2, 0).when(F.col("turn_") < 4, 1).otherwise(2))
    latest = told.groupBy("tenant", "session_id").agg(F.max("batch").alias("batch"))
    return kept.join(latest, ["tenant", "session_id", "batch"], "left_semi").select("tenant", "session_id", "id", "role", "position")


@query(f"""
WITH {M._EPISODES}, left_ AS (SELECT * FROM episodes WHERE NOT archived AND CAST(id AS BIGINT) % 1000 > 3)
SELECT count(*) AS depth, min(created_at) AS oldest_ms, max(created_at) AS newest_ms FROM left_
""")
def scoring_backlog(spark: SparkSession, folder: str) -> DataFrame:
    """What is left to score when two of three parts have come in."""
    to = scratch_path(spark, "backlog")

    def run(stream: DataFrame) -> None:
        jobs.score_stream(stream, f"{to}/out", f"{to}/checkpoint", providers.Plain()).awaitTermination()

    _in_parts(spark, _turns(spark, folder), _PARTS[:2], to, run)
    return jobs.backlog(M.episodes(spark, folder), spark.read.parquet(f"{to}/out"))


# -- aliases ----------------------------------------------------------------------------------------

_RESOLVED = f"""
raw AS ({A.for_duckdb(A.LOG)}), m AS ({A.for_duckdb(A.ALIASES)}),
names AS (SELECT tenant, lower(name) AS e, arg_min(name, (seq, name)) AS canonical, min(seq) AS seq FROM m GROUP BY ALL),
others AS (SELECT a.tenant, a.k, a.seq, n.canonical FROM (SELECT tenant, lower(name) AS e, lower(unnest(aliases)) AS k, seq FROM m) a JOIN names n ON n.tenant = a.tenant AND n.e = a.e),
known AS (SELECT tenant, e AS k, seq, 0 AS r, canonical FROM names UNION ALL SELECT tenant, k, seq, 1, canonical FROM others),
told AS (SELECT DISTINCT tenant, lower(trim(x)) AS k, seq FROM (SELECT tenant, subject AS x, seq FROM raw UNION ALL SELECT tenant, object, seq FROM raw)),
best AS (SELECT t.tenant, t.k, t.seq, arg_min(canonical, (r, canonical)) AS c FROM told t JOIN known n ON n.tenant = t.tenant AND n.k = t.k AND n.seq <= t.seq GROUP BY ALL),
log AS (
  SELECT raw.tenant, raw.seq, ts, op, coalesce(s.c, subject) AS subject, predicate, coalesce(o.c, object) AS object, confidence, source FROM raw
  LEFT JOIN best s ON s.tenant = raw.tenant AND s.k = lower(trim(subject)) AND s.seq = raw.seq LEFT JOIN best o ON o.tenant = raw.tenant AND o.k = lower(trim(object)) AND o.seq = raw.seq
)"""


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return K.resolve_log(M.log(spark, folder), K.alias_history(A.adapted(spark, folder, A.ALIASES)))


@query(f"WITH {_RESOLVED} SELECT tenant, seq, subject, predicate, object FROM log")
def log_with_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Each row of the log by the names that its aliases stood for when it came in."""
    return _resolved(spark, folder).select("tenant", "seq", "subject", "predicate", "object")


@query(f"WITH {_RESOLVED}, {M._VERSIONS.replace(M._LOG + ',', '')} SELECT {', '.join(M._FACT_COLUMNS)} FROM facts")
def fact_versions_with_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return M._fact_view(K.versions(_resolved(spark, folder)))


# -- event time, tables, statistics -----------------------------------------------------------------


def _by_time(sql: str) -> str:
    for old, new in (("ORDER BY seq", "ORDER BY ts, seq"), ("min(seq) AS seq", "arg_min(seq, (ts, seq)) AS seq")):
        sql = sql.replace(old, new)
    for c in ("op", "subject", "object", "ts"):
        sql = sql.replace(f"arg_min({c}, seq)", f"arg_min({c}, (ts, seq))")
    return sql


_TIMED = f"WITH {_by_time(M._VERSIONS.replace(M._LOG, f'log AS ({A.for_duckdb(A.LATE_LOG)})'))} SELECT {', '.join(M._FACT_COLUMNS)} FROM facts"


def _quarters(rows: DataFrame, by: str = "seq") -> list[DataFrame]:
    most = rows.agg(F.max(by)).first()[0] or 0
    cuts = [-1, *(most * k // 4 for k in (1, 2, 3)), most]
    return [rows.where((F.col(by) > low) & (F.col(by) <= high)) for low, high in zip(cuts, cuts[1:], strict=False)]


@query(_TIMED)
def fact_versions_event_time(spark: SparkSession, folder: str) -> DataFrame:
    """Versions by the time of which rows speak."""
    return M._fact_view(K.versions(A.adapted(spark, folder, A.LATE_LOG), K.BY_TIME))


@query(_TIMED)
def fact_versions_late_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The same from four batches in the order of arrival, each spliced into what there is."""
    first, *rest = _quarters(A.adapted(spark, folder, A.LATE_LOG))
    have, log = written(K.versions(first, K.BY_TIME), "timed"), first
    for batch in rest:
        have = written(K.spliced(have, *K.splice(have, log, batch)), "timed")
        log = log.unionByName(batch)
    return M._fact_view(have)


@query(f"WITH {M._VERSIONS} SELECT {', '.join(M._FACT_COLUMNS)} FROM facts")
def fact_table_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The log in four ticks, each adding to a table of versions; one of them dies halfway and runs again."""
    table = FactTable(spark, scratch_path(spark, "fact-table"))
    for n, batch in enumerate(_quarters(M.log(spark, folder))):
        table.add(batch, NOW, n)
        table.add(batch, NOW, n)  # a tick that counts already adds nothing
    return M._fact_view(table.versions())


@query(f"""
WITH RECURSIVE {M._VERSIONS}, own AS (
  SELECT id, seq, CASE WHEN seq % 41 = 0 AND superseded_by IS NOT NULL THEN 'gone' WHEN superseded_by IS NULL AND skey = 'user_3' AND predicate = 'works_at' THEN first_value(id) OVER w ELSE superseded_by END AS link
  FROM facts WHERE predicate IN ('works_at', 'lives_in') WINDOW w AS (PARTITION BY tenant, skey, predicate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), back AS (
  SELECT id AS chain, id, 0::BIGINT AS steps, CASE WHEN link IS NULL THEN 'whole' ELSE 'gap' END AS state FROM own WHERE link IS NULL OR link = 'gone'
  UNION ALL SELECT b.chain, o.id, b.steps + 1, b.state FROM back b JOIN own o ON o.link = b.id
), left_ AS (SELECT * FROM own WHERE id NOT IN (SELECT id FROM back)),
reach AS (SELECT id AS start, link AS at FROM left_ UNION SELECT r.start, l.link FROM reach r JOIN left_ l ON l.id = r.at)
SELECT id, chain, steps, state FROM back
UNION ALL SELECT r.start, min(r.at), NULL, 'cycle' FROM reach r WHERE EXISTS (SELECT 1 FROM reach x WHERE x.start = r.at AND x.at = r.at) GROUP BY r.start
""")
def supersession_links(spark: SparkSession, folder: str) -> DataFrame:
    """Where links lead, some of which name nothing that is there, and some of which go round."""
    own = M.facts(spark, folder).where(F.col("predicate").isin("works_at", "lives_in"))
    first = own.groupBy("tenant", F.lower("subject").alias("_s"), "predicate").agg(F.min_by("id", "seq").alias("_first"))
    own = own.withColumn("_s", F.lower("subject")).join(first, ["tenant", "_s", "predicate"])
    to, last = F.col("superseded_by"), F.col("superseded_by").isNull()
    round_ = last & (F.col("_s") == "user_3") & (F.col("predicate") == "works_at")
    broken = F.when((F.col("seq") % 41 == 0) & ~last, "gone").when(round_, F.col("_first")).otherwise(to)
    return K.walk(own.select("id", broken.alias("superseded_by")))


@query(M._oracles["skill_success_rate"])
def skill_rates_in_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Success rates of four batches of uses, each going on from those before it."""
    first, *rest = _quarters(A.adapted(spark, folder, A.USES))
    rates = written(skills.success_rates(first), "rates")
    for batch in rest:
        rates = written(skills.success_rates(batch, rates), "rates")
    return rates


@query(M._oracles["entity_upsert"])
def entities_in_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of four batches of mentions, each going on from those before it."""
    first, *rest = _quarters(A.adapted(spark, folder, A.MENTIONS))
    known = written(K.upsert_entities(first), "entities")
    for batch in rest:
        known = written(K.upsert_entities(batch, known), "entities")
    return known.select("tenant", "canonical_name", "entity_type", "first_seen", "last_seen", "episode_count", M._joined("aliases"))


# -- a consolidation run ----------------------------------------------------------------------------

_SUBJECTS = " ".join(f"WHEN {M._quoted(t)} THEN {M._quoted(s)}" for t, s in SETTINGS.canonical_subjects.items())
_RUN = f"""
turns AS ({A.for_duckdb(A.PLAIN_TURNS)}), known AS ({A.for_duckdb(A.ALIASES)}), past AS ({A.for_duckdb(A.LOG)}),
lost AS (SELECT id, said FROM turns WHERE surprise IS NULL AND NOT archived ORDER BY created_at, id LIMIT {SETTINGS.rescore_limit}),
d AS (SELECT id, ('0x' || substr(md5(said), 1, 2))::INTEGER / 256e0 AS su, ('0x' || substr(md5(said), 3, 2))::INTEGER / 256e0 AS ar, ('0x' || substr(md5(said), 5, 2))::INTEGER / 256e0 AS se FROM lost),
new AS (SELECT id, su, greatest(0.4e0 * su + 0.3e0 * se + 0.2e0 * ar + 0.1e0 * 0e0, se) AS salience FROM d),
scored AS (SELECT t.* REPLACE (coalesce(n.salience, t.salience) AS salience, coalesce(n.su, t.surprise) AS surprise) FROM turns t LEFT JOIN new n ON n.id = t.id),
chosen AS (
  SELECT * FROM scored WHERE consolidated_at IS NULL AND NOT archived AND salience > {SETTINGS.consolidation_threshold} AND created_at <= {NOW - SETTINGS.consolidation_delay_ms}
  ORDER BY salience DESC, created_at, id LIMIT {SETTINGS.batch_size}
),
say AS (
  SELECT *, regexp_extract(said, '^I (works_at|lives_in|prefers|owns) ([A-Za-z0-9_ ]+)\\.$', 1) AS p, trim(regexp_extract(said, '^I (works_at|lives_in|prefers|owns) ([A-Za-z0-9_ ]+)\\.$', 2)) AS o,
    CASE tenant {_SUBJECTS} ELSE tenant END AS s FROM chosen
),
-- each speaking turn makes an entity of its object, and then its fact: two numbers
turned AS (SELECT *, (SELECT max(seq) FROM past) + 2 * row_number() OVER (ORDER BY salience DESC, created_at, id) AS seq FROM say WHERE p <> ''),
m AS (SELECT tenant, name, aliases, seq - 1000000000 AS seq FROM known UNION ALL SELECT tenant, o, [], seq - 1 FROM turned),
names AS (SELECT tenant, lower(name) AS e, arg_min(name, (seq, name)) AS canonical, min(seq) AS seq FROM m GROUP BY ALL),
others AS (SELECT a.tenant, a.k, a.seq, n.canonical FROM (SELECT tenant, lower(name) AS e, lower(unnest(aliases)) AS k, seq FROM m) a JOIN names n ON n.tenant = a.tenant AND n.e = a.e),
every AS (SELECT tenant, e AS k, seq, 0 AS r, canonical FROM names UNION ALL SELECT tenant, k, seq, 1, canonical FROM others),
told AS (SELECT DISTINCT tenant, lower(trim(x)) AS k, seq FROM (SELECT tenant, s AS x, seq FROM turned UNION ALL SELECT tenant, o, seq FROM turned)),
best AS (SELECT t.tenant, t.k, t.seq, arg_min(canonical, (r, canonical)) AS c FROM told t JOIN every n ON n.tenant = t.tenant AND n.k = t.k AND n.seq <= t.seq GROUP BY ALL),
asserted AS (
  SELECT t.tenant, t.seq, {NOW} AS ts, 'assert' AS op, coalesce(b.c, s) AS subject, p AS predicate, coalesce(x.c, o) AS object, 0.9e0 AS confidence, t.id AS source
  FROM turned t LEFT JOIN best b ON b.tenant = t.tenant AND b.k = lower(trim(s)) AND b.seq = t.seq LEFT JOIN best x ON x.tenant = t.tenant AND x.k = lower(trim(o)) AND x.seq = t.seq
), log AS (SELECT * FROM past UNION ALL SELECT * FROM asserted), {M._VERSIONS.replace(M._LOG + ",", "")}
"""


def _run(spark: SparkSession, folder: str) -> consolidation.Run:
    rows = A.adapted(spark, folder, A.PLAIN_TURNS).drop("content").withColumnRenamed("said", "content")
    known = K.upsert_entities(A.adapted(spark, folder, A.ALIASES))
    return consolidation.run_once(rows, M.log(spark, folder), NOW, SETTINGS, providers.Plain(), entities=known)


@query(f"""
WITH {_RUN}, acted AS (
  SELECT CASE WHEN fresh AND slot = '' AND op1 = 'assert' THEN 'superseded' WHEN fresh THEN 'inserted' ELSE 'duplicate' END AS action FROM l4 WHERE op = 'assert' AND seq > (SELECT max(seq) FROM past)
), after AS (
  SELECT s.*, CASE WHEN archived THEN archived ELSE false END AS was, c.id IS NOT NULL OR consolidated_at IS NOT NULL AS done,
    greatest(0e0, decay_state - 0.05e0 * (({NOW} - coalesce(last_decayed_at, s.created_at)) / 86400000e0) * (2e0 - s.salience)) AS decayed
  FROM scored s LEFT JOIN (SELECT id FROM chosen) c ON c.id = s.id
), ruled AS (SELECT CASE WHEN was THEN NULL WHEN decayed < 0.1 AND done THEN 1 WHEN created_at < {NOW - 90 * DAY_MS} AND salience < 0.6 AND NOT done THEN 2 END AS rule FROM after)
SELECT (SELECT count(*) FROM lost) AS rescored, (SELECT count(*) FROM chosen) AS candidates, 0::BIGINT AS failed, count(*) FILTER (WHERE action = 'inserted') AS inserted,
  count(*) FILTER (WHERE action = 'superseded') AS superseded, count(*) FILTER (WHERE action = 'duplicate') AS duplicate,
  (SELECT count(*) FROM ruled WHERE rule = 1) AS faded, (SELECT count(*) FROM ruled WHERE rule = 2) AS expired FROM acted
""")
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a run whose scores and facts SQL can follow."""
    return _run(spark, folder).report


@query(f"WITH {_RUN} SELECT tenant, seq, subject, predicate, object, confidence, source FROM asserted")
def run_assertions(spark: SparkSession, folder: str) -> DataFrame:
    """What the run asserts, by the names known by then."""
    return _run(spark, folder).assertions.select("tenant", "seq", "subject", "predicate", "object", "confidence", "source")


@query(f"WITH {_RUN} SELECT {', '.join(M._FACT_COLUMNS)} FROM facts WHERE valid_until IS NULL OR valid_until = {NOW} AND seq <= (SELECT max(seq) FROM past)")
def run_open_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The versions that hold after the run, and those that it closed."""
    have = written(M.facts(spark, folder), "facts")
    changed = _run(spark, folder).changed
    every = K.apply(have, changed)
    return M._fact_view(every.where(F.col("valid_until").isNull() | ((F.col("valid_until") == NOW) & (F.col("seq") <= M.log(spark, folder).agg(F.max("seq")).first()[0]))))


@query(f"WITH {_RUN} SELECT id, round(salience, 6) AS salience FROM new")
def run_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder).scores.select("id", F.round("salience", 6).alias("salience"))
