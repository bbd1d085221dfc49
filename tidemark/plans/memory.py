"""Queries of the memory engine over the adapted tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DAY_MS, ENTITY_LABELS, ENTITY_TYPES, FUNCTIONAL, LINK_FAMILIES, MONTHS, MULTI, PREDICATE_KIN, PREDICATE_LABELS, QUESTION_PATTERNS, Settings
from ..functions import text as X
from ..functions import vectors as V
from ..operators import consolidation, evaluation, extraction, graph, prompts, reports, router, salience, skills
from ..operators import episodes as E
from ..operators import facts as K
from ..operators.order import numbered
from ..sources import adapters as A
from ..sources import files, read_table
from ..sources.scratch import scratch_path, written
from ..streaming import jobs, working

NOW = A.NOW_MS
SETTINGS = Settings(canonical_subjects={"t0": "user_0", "t1": "user_1", "t2": "user_2"})
QUESTION = "der und die the of le la que"
ASKED = 7  # the vector that searches ask for
WINDOW = (A.BASE_MS + 10 * DAY_MS, A.BASE_MS + 60 * DAY_MS)

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with DuckDB SQL if there is any."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql.strip()
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# -- shared inputs ----------------------------------------------------------------------------------


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    return A.adapted(spark, folder, A.EPISODES)


def log(spark: SparkSession, folder: str) -> DataFrame:
    return A.adapted(spark, folder, A.LOG)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return K.versions(log(spark, folder))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    own = read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return episodes(spark, folder).select("id", "vec_id").join(own, "vec_id").select("id", "vec_id", "vector")


def fact_vectors(spark: SparkSession, folder: str, every: DataFrame) -> DataFrame:
    own = read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    size = own.agg(F.count("*").alias("size"))  # one row
    placed = every.crossJoin(F.broadcast(size)).withColumn("vec_id", F.col("seq") % F.col("size"))
    return placed.join(own, "vec_id").select("id", "vec_id", "vector")


def codes(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(spark, folder).select("id", V.sparse_code(F.col("content"), F.col("created_at")).alias("code"))


def asked_vector(spark: SparkSession, folder: str) -> list[float]:
    row = read_table(spark, folder, "embeddings").where(F.col("vec_id") == ASKED).select("embedding").first()
    return list(row[0]) if row else []


def _joined(column: str, by: str = ",") -> F.Column:
    return F.array_join(column, by).alias(column)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EPISODES = f"episodes AS ({A.for_duckdb(A.EPISODES)})"
_LOG = f"log AS ({A.for_duckdb(A.LOG)})"
_NAMES = "'" + "', '".join((*FUNCTIONAL, *MULTI)) + "'"
_VERSIONS = f"""
{_LOG}, l0 AS (
  SELECT *, lower(subject) AS skey, lower(object) AS okey,
    CASE WHEN predicate IN ('works_at', 'lives_in') THEN '' ELSE lower(object) END AS slot
  FROM log WHERE predicate IN ({_NAMES})
), l1 AS (
  SELECT *, last_value(CASE WHEN op = 'assert' THEN okey END IGNORE NULLS) OVER (PARTITION BY tenant, skey, predicate, slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
  FROM l0
), l2 AS (
  SELECT *, lag(op) OVER (PARTITION BY tenant, skey, predicate, slot ORDER BY seq) AS before FROM l1 WHERE op = 'assert' OR held = okey
), l3 AS (
  SELECT *, lag(op) OVER (PARTITION BY tenant, skey, predicate, slot ORDER BY seq) AS op1, lag(okey) OVER (PARTITION BY tenant, skey, predicate, slot ORDER BY seq) AS ok1
  FROM l2 WHERE NOT (op = 'retract' AND coalesce(before, 'retract') = 'retract')
), l4 AS (
  SELECT *, op = 'retract' OR op1 IS NULL OR op1 = 'retract' OR ok1 <> okey AS fresh FROM l3
), l5 AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY tenant, skey, predicate, slot ORDER BY seq) AS version FROM l4
), v0 AS (
  SELECT tenant, skey, predicate, slot, version, arg_min(op, seq) AS op, min(seq) AS seq, arg_min(subject, seq) AS subject, arg_min(object, seq) AS object,
    arg_min(ts, seq) AS valid_from, max(confidence) AS confidence, count(*) AS asserted, string_agg(source, ',' ORDER BY seq) AS sources
  FROM l5 GROUP BY ALL
), v1 AS (
  SELECT *, 'f' || seq AS id, lead(valid_from) OVER w AS valid_until, CASE WHEN lead(op) OVER w = 'assert' THEN 'f' || lead(seq) OVER w END AS superseded_by
  FROM v0 WINDOW w AS (PARTITION BY tenant, skey, predicate, slot ORDER BY version)
), facts AS (SELECT * FROM v1 WHERE op = 'assert')
"""
_FACT_COLUMNS = ("id", "tenant", "subject", "predicate", "object", "valid_from", "valid_until", "confidence", "sources", "superseded_by", "asserted")
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _fact_view(rows: DataFrame) -> DataFrame:
    return rows.select(*(_joined(c) if c == "sources" else c for c in _FACT_COLUMNS))


# -- facts ------------------------------------------------------------------------------------------


@query(f"WITH {_VERSIONS} SELECT {', '.join(_FACT_COLUMNS)} FROM facts WHERE valid_until IS NULL")
def current_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_view(K.current(facts(spark, folder)))


@query(f"""
WITH {_VERSIONS}
SELECT tenant, subject, predicate, object, valid_from, valid_until,
  row_number() OVER (PARTITION BY tenant, skey, predicate ORDER BY valid_from, seq)::INTEGER AS version_no
FROM facts WHERE skey IN ('user_7', 'user_8') AND predicate IN ('works_at', 'prefers')
""")
def fact_history(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [(f"t{u % 3}", f"user_{u}", p) for u in (7, 8) for p in ("works_at", "prefers")]
    pairs = spark.createDataFrame(wanted, "tenant string, subject string, predicate string")
    return K.history(facts(spark, folder), pairs).select("tenant", "subject", "predicate", "object", "valid_from", "valid_until", "version_no")


@query(f"WITH {_VERSIONS} SELECT {', '.join(_FACT_COLUMNS)} FROM facts WHERE predicate IN ('works_at', 'lives_in')")
def fact_versions_functional(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_view(facts(spark, folder).where(F.col("predicate").isin(*FUNCTIONAL)))


@query(f"WITH {_VERSIONS} SELECT {', '.join(_FACT_COLUMNS)} FROM facts WHERE predicate NOT IN ('works_at', 'lives_in')")
def fact_versions_multi(spark: SparkSession, folder: str) -> DataFrame:
    return _fact_view(facts(spark, folder).where(F.col("predicate").isin(*MULTI)))


@query(f"""
WITH {_VERSIONS}
SELECT seq, tenant, predicate,
  CASE WHEN fresh AND slot = '' AND op1 = 'assert' THEN 'superseded' WHEN fresh THEN 'inserted' ELSE 'duplicate' END AS action
FROM l4 WHERE op = 'assert'
""")
def fact_actions(spark: SparkSession, folder: str) -> DataFrame:
    return K.actions(log(spark, folder))


@query(f"WITH {_VERSIONS} SELECT seq, tenant, subject, predicate, object FROM l4 WHERE op = 'retract'")
def fact_retractions(spark: SparkSession, folder: str) -> DataFrame:
    return K.retractions(log(spark, folder))


@query(f"WITH {_VERSIONS} SELECT id, tenant, confidence, asserted, sources FROM facts WHERE asserted > 1")
def duplicate_merge(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).where("asserted > 1").select("id", "tenant", "confidence", "asserted", _joined("sources"))


@query(f"""
WITH {_VERSIONS}, twice AS (SELECT * FROM facts UNION ALL SELECT * FROM facts WHERE seq % 5 = 0),
d AS (SELECT 1 FROM twice WHERE valid_until IS NULL GROUP BY tenant, skey, predicate, lower(object) HAVING count(*) > 1)
SELECT count(*) AS duplicates FROM d
""")
def duplicate_current_count(spark: SparkSession, folder: str) -> DataFrame:
    """Over a table in which a fifth of the versions came in twice."""
    every = facts(spark, folder)
    return K.duplicate_current(every.union(every.where("seq % 5 = 0")))


@query(f"WITH {_VERSIONS} SELECT {', '.join(_FACT_COLUMNS)} FROM facts")
def fact_versions_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The log in four batches by seq, each against the open versions that the ones before it left."""
    rows = log(spark, folder)
    most = rows.agg(F.max("seq")).first()[0] or 0
    cuts = [most * k // 4 for k in (1, 2, 3)]
    have = written(K.versions(rows.where(F.col("seq") <= cuts[0])), "facts")
    for low, high in zip(cuts, [*cuts[1:], most], strict=True):
        have = written(K.apply(have, K.advance(have, rows.where((F.col("seq") > low) & (F.col("seq") <= high)))), "facts")
    return _fact_view(have)


@query(f"""
WITH {_VERSIONS}, cut AS (SELECT max(seq) * 3 // 4 AS c FROM log)
, acted AS (
  SELECT CASE WHEN fresh AND slot = '' AND op1 = 'assert' THEN 'superseded' WHEN fresh THEN 'inserted' ELSE 'duplicate' END AS action FROM l4, cut WHERE op = 'assert' AND seq > c
)
SELECT e.action, count(a.action) AS n FROM (SELECT unnest(['inserted', 'superseded', 'duplicate']) AS action) e LEFT JOIN acted a ON a.action = e.action GROUP BY e.action
""")
def batch_action_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Actions of the last quarter of the log, by the open versions before it."""
    rows = log(spark, folder)
    cut = (rows.agg(F.max("seq")).first()[0] or 0) * 3 // 4
    have = written(K.versions(rows.where(F.col("seq") <= cut)), "facts")
    return K.action_counts(K.batch_actions(have, rows.where(F.col("seq") > cut)))


@query(f"""
WITH {_VERSIONS.replace(_LOG, "log AS (SELECT * FROM (" + A.for_duckdb(A.LOG) + ") UNION ALL SELECT 't1', 1000000000 + ref_id, " + str(NOW) + ", 'assert', subject, predicate, object, 1e0, 'seed_import' FROM (" + A.for_duckdb(A.REFERENCE_FACTS) + "))")}
, acted AS (
  SELECT CASE WHEN fresh AND slot = '' AND op1 = 'assert' THEN 'superseded' WHEN fresh THEN 'inserted' ELSE 'duplicate' END AS action FROM l4 WHERE op = 'assert' AND seq >= 1000000000
)
SELECT e.action, count(a.action) AS n FROM (SELECT unnest(['inserted', 'superseded', 'duplicate']) AS action) e LEFT JOIN acted a ON a.action = e.action GROUP BY e.action
""")
def seed_fact_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Reference facts asserted after the log."""
    refs = A.adapted(spark, folder, A.REFERENCE_FACTS).withColumn("tenant", F.lit("t1"))
    return K.action_counts(K.batch_actions(facts(spark, folder), K.seeds(refs, 1_000_000_000, NOW)))


@query(f"""
WITH {_VERSIONS}
SELECT id, tenant, predicate, object, row_number() OVER (PARTITION BY tenant, predicate ORDER BY object, id)::INTEGER AS position FROM facts WHERE valid_until IS NULL
""")
def facts_listed(spark: SparkSession, folder: str) -> DataFrame:
    return K.listed(facts(spark, folder)).select("id", "tenant", "predicate", "object", "position")


@query(f"""
WITH RECURSIVE {_VERSIONS}, own AS (SELECT id, superseded_by, object FROM facts WHERE predicate IN ('works_at', 'lives_in')),
walk AS (
  SELECT id AS chain, id, 0 AS steps FROM own WHERE superseded_by IS NULL
  UNION ALL SELECT w.chain, o.id, w.steps + 1 FROM walk w JOIN own o ON o.superseded_by = w.id
)
SELECT chain, w.id, steps::INTEGER AS steps, object FROM walk w JOIN own o ON o.id = w.id
""")
def supersession_chain(spark: SparkSession, folder: str) -> DataFrame:
    return K.chains(facts(spark, folder)).select("chain", "id", "steps", "object")


@query(f"WITH {_VERSIONS} SELECT id, tenant, subject, predicate, object FROM facts WHERE valid_from <= 1705000000000 AND (valid_until IS NULL OR valid_until > 1705000000000)")
def facts_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return K.as_of(facts(spark, folder), 1_705_000_000_000).select("id", "tenant", "subject", "predicate", "object")


@query(f"""
WITH {_VERSIONS}, own AS (SELECT *, predicate = 'owns' AND lower(object) = 'item 3' AS hit FROM facts WHERE valid_until IS NULL AND tenant = 't1' AND skey = 'user_7')
SELECT id, predicate, object, hit FROM own WHERE hit OR NOT (SELECT bool_or(hit) FROM own)
""")
def forget_or_list(spark: SparkSession, folder: str) -> DataFrame:
    return K.forget(facts(spark, folder), "t1", "user_7", "owns", "Item 3").select("id", "predicate", "object", "hit")


@query(f"""
WITH entities AS ({A.for_duckdb(A.ENTITIES)}), names AS ({A.for_duckdb(A.NAMES)}),
keys AS (
  SELECT tenant, lower(canonical_name) AS k, canonical_name, 0 AS r FROM entities
  UNION ALL SELECT tenant, lower(unnest(aliases)), canonical_name, 1 FROM entities
), best AS (SELECT tenant, k, arg_min(canonical_name, (r, canonical_name)) AS c FROM keys WHERE k <> '' GROUP BY ALL)
SELECT name_id, n.tenant, name, coalesce(c, name) AS canonical FROM names n LEFT JOIN best b ON b.tenant = n.tenant AND b.k = lower(trim(name))
""")
def alias_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return K.resolve_names(A.adapted(spark, folder, A.NAMES), A.adapted(spark, folder, A.ENTITIES)).select("name_id", "tenant", "name", "canonical")


@query(f"""
WITH m AS (SELECT *, lower(name) AS k FROM ({A.for_duckdb(A.MENTIONS)})),
grp AS (
  SELECT tenant, k, arg_min(name, seq) AS canonical_name, arg_min(entity_type, seq) FILTER (WHERE entity_type IS NOT NULL) AS entity_type,
    min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS episode_count FROM m GROUP BY ALL
), a AS (SELECT tenant, k, seq, unnest(aliases) AS alias, unnest(range(len(aliases))) AS pos FROM m),
f AS (SELECT tenant, k, lower(alias) AS la, min((seq, pos, alias)) AS s FROM a WHERE lower(alias) <> k GROUP BY ALL),
j AS (SELECT tenant, k, string_agg(s[3], ',' ORDER BY s) AS aliases FROM f GROUP BY ALL)
SELECT b.tenant, canonical_name, entity_type, first_seen, last_seen, episode_count, coalesce(aliases, '') AS aliases FROM grp b LEFT JOIN j ON j.tenant = b.tenant AND j.k = b.k
""")
def entity_upsert(spark: SparkSession, folder: str) -> DataFrame:
    found = K.upsert_entities(A.adapted(spark, folder, A.MENTIONS))
    return found.select("tenant", "canonical_name", "entity_type", "first_seen", "last_seen", "episode_count", _joined("aliases"))


_COSINE = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query(f"""
WITH {_VERSIONS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = {ASKED}),
near AS (
  SELECT f.id, {_COSINE.format("e.embedding", "q.embedding")} AS similarity
  FROM facts f JOIN embeddings e ON e.vec_id = f.seq % (SELECT count(*) FROM embeddings), q ORDER BY similarity DESC, f.id LIMIT 40
)
SELECT f.id, round(similarity, 6) AS similarity FROM near n JOIN facts f ON f.id = n.id WHERE tenant = 't1' AND valid_until IS NULL ORDER BY n.similarity DESC, f.id LIMIT 10
""")
def fact_search_overfetch(spark: SparkSession, folder: str) -> DataFrame:
    every = facts(spark, folder)
    return K.search(every, fact_vectors(spark, folder, every), asked_vector(spark, folder), "t1", SETTINGS, k=10).select("id", F.round("similarity", 6).alias("similarity"))


# -- episodes ---------------------------------------------------------------------------------------


@query(f"""
WITH {_EPISODES}
SELECT id, created_at, salience FROM episodes
WHERE tenant = 't1' AND NOT archived AND salience >= 0.4 AND created_at BETWEEN {WINDOW[0]} AND {WINDOW[1]}
""")
def episode_filter_window(spark: SparkSession, folder: str) -> DataFrame:
    return E.matching(episodes(spark, folder), "t1", None, WINDOW, 0.4).select("id", "created_at", "salience")


@query(f"WITH {_EPISODES} SELECT id, role, created_at FROM episodes WHERE id = '7001'")
def episode_by_id(spark: SparkSession, folder: str) -> DataFrame:
    return E.by_id(episodes(spark, folder), "7001").select("id", "role", "created_at")


@query(f"""
WITH {_EPISODES}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, id DESC) AS back FROM episodes WHERE NOT archived)
SELECT tenant, id, row_number() OVER (PARTITION BY tenant ORDER BY created_at, id)::INTEGER AS position FROM r WHERE back <= 10
""")
def episode_recent_n(spark: SparkSession, folder: str) -> DataFrame:
    return E.recent_each(episodes(spark, folder), 10).select("tenant", "id", "position")


@query(f"WITH {_EPISODES} SELECT id, created_at FROM episodes WHERE surprise IS NULL AND NOT archived ORDER BY created_at, id LIMIT 50")
def unscored_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return E.unscored(episodes(spark, folder)).select("id", "created_at")


@query(f"""
WITH {_EPISODES}
SELECT id, salience FROM episodes WHERE consolidated_at IS NULL AND NOT archived AND salience > 0.6 AND created_at <= {NOW} - 3600000
ORDER BY salience DESC, created_at, id LIMIT 20
""")
def consolidation_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return E.candidates(episodes(spark, folder), NOW, SETTINGS).select("id", "salience")


@query(f"""
WITH {_EPISODES}, d AS (SELECT *, surprise IS NOT NULL AND NOT archived AND consolidated_at IS NULL AND salience > 0.6 AS due FROM episodes)
SELECT tenant, count(*) FILTER (WHERE surprise IS NULL AND NOT archived) AS unscored, count(*) FILTER (WHERE due AND created_at <= {NOW} - 3600000) AS ready,
  count(*) FILTER (WHERE due AND created_at > {NOW} - 3600000) AS waiting FROM d GROUP BY tenant
""")
def pending_counts(spark: SparkSession, folder: str) -> DataFrame:
    return E.pending_counts(episodes(spark, folder), NOW, SETTINGS)


@query(f"""
WITH {_EPISODES}
SELECT id, round(greatest(0.4e0 * surprise + 0.3e0 * self_ref + 0.2e0 * arousal + 0.1e0 * recurrence, self_ref), 6) AS combined FROM episodes WHERE surprise IS NOT NULL
""")
def salience_combine(spark: SparkSession, folder: str) -> DataFrame:
    combined = salience.combine(*map(F.col, salience.SCORES))
    return episodes(spark, folder).where("surprise IS NOT NULL").select("id", F.round(combined, 6).alias("combined"))


_DECAYED = f"CASE WHEN archived THEN decay_state ELSE greatest(0e0, decay_state - 0.05e0 * (({NOW} - coalesce(last_decayed_at, created_at)) / 86400000e0) * (2e0 - salience)) END"


@query(f"WITH {_EPISODES} SELECT id, round({_DECAYED}, 6) AS decay_state, CASE WHEN archived THEN last_decayed_at ELSE {NOW} END AS last_decayed_at FROM episodes")
def decay_step(spark: SparkSession, folder: str) -> DataFrame:
    return E.decay(episodes(spark, folder), NOW, SETTINGS).select("id", F.round("decay_state", 6).alias("decay_state"), "last_decayed_at")


_RULES = f"""
{_EPISODES}, ruled AS (
  SELECT *, CASE WHEN archived THEN NULL WHEN decay_state < 0.1 AND consolidated_at IS NOT NULL THEN 1
    WHEN created_at < {NOW - 90 * DAY_MS} AND salience < 0.6 AND consolidated_at IS NULL THEN 2 END AS rule FROM episodes
)"""


@query(f"WITH {_RULES} SELECT id, rule::INTEGER AS archive_rule, archived OR rule IS NOT NULL AS archived FROM ruled")
def archive_rules(spark: SparkSession, folder: str) -> DataFrame:
    return E.archive(episodes(spark, folder), NOW, SETTINGS).select("id", "archive_rule", "archived")


@query(f"WITH {_RULES} SELECT rule::INTEGER AS archive_rule, count(*) AS n FROM ruled WHERE rule IS NOT NULL GROUP BY rule")
def archive_dry_run(spark: SparkSession, folder: str) -> DataFrame:
    return E.archive(episodes(spark, folder), NOW, SETTINGS).where("archive_rule IS NOT NULL").groupBy("archive_rule").agg(F.count("*").alias("n"))


@query(f"WITH {_RULES} SELECT count(*) FILTER (WHERE NOT archived) AS decayed, count(*) FILTER (WHERE rule = 1) AS faded, count(*) FILTER (WHERE rule = 2) AS expired FROM ruled")
def dry_run(spark: SparkSession, folder: str) -> DataFrame:
    return E.dry_run(episodes(spark, folder), NOW, SETTINGS)


@query(f"WITH {_RULES} SELECT r.id, len(e.embedding)::INTEGER AS dims FROM ruled r JOIN embeddings e ON e.vec_id = r.vec_id WHERE NOT archived AND rule IS NULL")
def archive_survivors(spark: SparkSession, folder: str) -> DataFrame:
    left = E.survivors(vectors(spark, folder), E.archive(episodes(spark, folder), NOW, SETTINGS))
    return left.select("id", F.size("vector").alias("dims"))


@query(f"WITH {_EPISODES} SELECT id, round(pow(2e0, -greatest(0e0, ({NOW} - created_at) / 86400000e0) / 30e0), 6) AS recency FROM episodes")
def recency(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(spark, folder).select("id", F.round(V.recency(F.col("created_at"), NOW, SETTINGS.half_life_days), 6).alias("recency"))


_AT = "(DATE '1970-01-01' + (created_at // 86400000)::INTEGER)"
_BUCKET = f"year({_AT}) || '-W' || weekofyear({_AT}) || '-' || (isodow({_AT}) - 1) || '-' || ((created_at // 3600000) % 24) // 4"


@query(f"WITH {_EPISODES} SELECT id, {_BUCKET} AS bucket FROM episodes")
def time_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(spark, folder).select("id", X.time_bucket(F.col("created_at")).alias("bucket"))


_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)[:64]"


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len({_FIRST.format('t')})::INTEGER AS n, array_to_string({_FIRST.format('t')}, ' ') AS tokens FROM t")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    tokens = X.tokenize(F.col("text"))
    return read_table(spark, folder, "documents").select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


_CODES = f"""
tok AS (SELECT id, {_BUCKET} AS bucket, {_TOKENS.format("content")} AS t FROM episodes),
pos AS (SELECT id, unnest({_FIRST.format("t")}) AS w FROM tok),
bit AS (SELECT DISTINCT id, ('0x' || substr(md5(w), 1, 4))::BIGINT % 224 AS p FROM pos),
word AS (SELECT id, p // 32 AS n, sum(1::BIGINT << (p % 32))::BIGINT AS v FROM bit GROUP BY ALL),
code AS (
  SELECT t.id, list_transform(range(7), lambda k: coalesce(m[k::INTEGER], 0)) || [('0x' || substr(md5(bucket), 1, 8))::BIGINT] AS code
  FROM tok t LEFT JOIN (SELECT id, map(list(n::INTEGER), list(v)) AS m FROM word GROUP BY id) w ON w.id = t.id
)"""


@query(f"WITH {_EPISODES}, {_CODES} SELECT id, array_to_string(code, ',') AS code FROM code")
def sparse_code_md5(spark: SparkSession, folder: str) -> DataFrame:
    return codes(spark, folder).select("id", F.array_join("code", ",").alias("code"))


_APART = "list_sum(list_transform(list_zip({0}, {1}), lambda z: bit_count(xor(z[1], z[2]))))"


@query(f"""
WITH {_EPISODES}, {_CODES}, q AS (SELECT code FROM code WHERE id = '7001')
SELECT c.id, {_APART.format("c.code", "q.code")}::INTEGER AS distance FROM code c, q ORDER BY distance, c.id LIMIT 50
""")
def hamming_topk(spark: SparkSession, folder: str) -> DataFrame:
    every = codes(spark, folder)
    row = every.where("id = '7001'").first()
    asked = F.array(*(F.lit(x).cast("long") for x in (row["code"] if row else [])))
    return every.select("id", V.hamming(F.col("code"), asked).alias("distance")).orderBy("distance", "id").limit(50)


@query(f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = {ASKED})
SELECT vec_id, round(similarity, 5) AS similarity FROM (
  SELECT vec_id, {_COSINE.format("e.embedding", "q.embedding")} AS similarity FROM embeddings e, q ORDER BY similarity DESC, vec_id LIMIT 50)
""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = E.nearest(read_table(spark, folder, "embeddings"), asked_vector(spark, folder), 50, "vec_id", "embedding")
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"))


def _hybrid_sql(pre: bool) -> str:
    seed = f"""SELECT list_transform(range(7), lambda k: coalesce(m[k::INTEGER], 0)) || [('0x' || substr(md5(
      year(DATE '1970-01-01' + ({NOW} // 86400000)::INTEGER) || '-W' || weekofyear(DATE '1970-01-01' + ({NOW} // 86400000)::INTEGER) || '-'
      || (isodow(DATE '1970-01-01' + ({NOW} // 86400000)::INTEGER) - 1) || '-' || (({NOW} // 3600000) % 24) // 4), 1, 8))::BIGINT] AS code
      FROM (SELECT map(list(n::INTEGER), list(v)) AS m FROM (SELECT p // 32 AS n, sum(1::BIGINT << (p % 32))::BIGINT AS v
        FROM (SELECT DISTINCT ('0x' || substr(md5(unnest(string_split('{QUESTION}', ' '))), 1, 4))::BIGINT % 224 AS p) GROUP BY ALL))"""
    held = "tenant = 't1' AND NOT archived AND salience >= 0.2"
    return f"""
WITH {_EPISODES}, {_CODES}, q AS (SELECT embedding FROM embeddings WHERE vec_id = {ASKED}), qc AS ({seed}),
near AS (
  SELECT e.id, {_COSINE.format("v.embedding", "q.embedding")} AS dense FROM episodes e JOIN embeddings v ON v.vec_id = e.vec_id, q
  {f"WHERE {held}" if pre else ""} ORDER BY dense DESC, e.id LIMIT 50
)
SELECT e.id, round(0.7e0 * dense + 0.3e0 * (1e0 - {_APART.format("c.code", "qc.code")} / 256e0)
  + 0.1e0 * pow(2e0, -greatest(0e0, ({NOW} - created_at) / 86400000e0) / 30e0), 6) AS score
FROM near n JOIN episodes e ON e.id = n.id JOIN code c ON c.id = n.id, qc WHERE {held}
ORDER BY 0.7e0 * dense + 0.3e0 * (1e0 - {_APART.format("c.code", "qc.code")} / 256e0)
  + 0.1e0 * pow(2e0, -greatest(0e0, ({NOW} - created_at) / 86400000e0) / 30e0) DESC, e.id LIMIT 10"""


def _hybrid(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    found = E.search(
        episodes(spark, folder), vectors(spark, folder), None, asked_vector(spark, folder), QUESTION, NOW, SETTINGS, 10, mode, tenant="t1", min_salience=0.2
    )
    return found.select("id", F.round("score", 6).alias("score"))


@query(_hybrid_sql(False))
def hybrid_search_post(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, "post")


@query(_hybrid_sql(True))
def hybrid_search_pre(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder, "pre")


@query(f"""
WITH {_EPISODES}
SELECT id, coalesce(string_agg(content, '|') OVER (PARTITION BY tenant, session_id ORDER BY created_at, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM episodes
""")
def scoring_context_5(spark: SparkSession, folder: str) -> DataFrame:
    return E.scoring_context(episodes(spark, folder), 5).select("id", _joined("history", "|"))


@query(f"""
WITH {_EPISODES}
SELECT id, coalesce(string_agg(content, '|') OVER (PARTITION BY tenant ORDER BY created_at, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history, {NOW} AS last_decayed_at FROM episodes
""")
def import_replay(spark: SparkSession, folder: str) -> DataFrame:
    return E.replay(episodes(spark, folder), NOW).select("id", _joined("history", "|"), "last_decayed_at")


@query(f"""
WITH {_EPISODES}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM episodes WHERE tenant = 't1'),
b AS (SELECT n_nationkey + 1 AS position, n_name AS label FROM nation)
SELECT coalesce(a.position, b.position) AS position, id, label, id IS NOT NULL AND label IS NOT NULL AS paired FROM a FULL JOIN b ON a.position = b.position
""")
def labels_by_position(spark: SparkSession, folder: str) -> DataFrame:
    own = numbered(episodes(spark, folder).where("tenant = 't1'").select("id"), ["id"])
    named = read_table(spark, folder, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("position"), F.col("n_name").alias("label"))
    return E.zipped(own, named).select("position", "id", "label", "paired")


@query(f"""
WITH {_EPISODES}, h AS (
  SELECT *, list(content) OVER (PARTITION BY tenant, session_id ORDER BY created_at, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM episodes
)
SELECT id, {_quoted(prompts.SCORES)} || CASE WHEN l IS NULL OR len(l) = 0 THEN {_quoted(prompts.FIRST)} ELSE array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) END
    || chr(10) || 'Message:' || chr(10) || content AS salience,
  {_quoted(prompts.FACTS)} || tenant || {_quoted(prompts.SPEAKER)} || role || ', ' || strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%SZ') || '):' || chr(10) || content AS extraction
FROM h
""")
def model_prompts(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.scoring_context(episodes(spark, folder), 5)
    extraction = prompts.extraction_prompt(F.col("content"), F.col("tenant"), F.col("role"), F.col("created_at"))
    return rows.select("id", prompts.salience_prompt(F.col("content"), F.col("history")).alias("salience"), extraction.alias("extraction"))


_WORKING = f"""
WITH {_EPISODES}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant, session_id ORDER BY created_at DESC, id DESC) AS back,
  count(*) OVER (PARTITION BY tenant, session_id) AS n FROM episodes)
SELECT tenant, session_id, id, role, (least(n, 5) - back + 1)::INTEGER AS position FROM r WHERE back <= 5
"""


@query(_WORKING)
def working_memory_last5(spark: SparkSession, folder: str) -> DataFrame:
    return E.working_memory(episodes(spark, folder)).select("tenant", "session_id", "id", "role", "position")


@query(f"""
WITH {_EPISODES}, r AS (SELECT 't' || (user_id % 3) AS tenant, (user_id % 40)::VARCHAR AS session_id, epoch_us(ts) // 1000 AS seen FROM events WHERE event_type = 'view'),
s AS (SELECT tenant, session_id, min(created_at) AS since, max(created_at) AS touched_at FROM episodes GROUP BY ALL),
x AS (SELECT s.tenant, s.session_id, max(seen) AS read FROM s JOIN r ON r.tenant = s.tenant AND r.session_id = s.session_id AND seen >= since GROUP BY ALL)
SELECT s.tenant, s.session_id, greatest(touched_at, coalesce(read, touched_at)) AS touched_at FROM s LEFT JOIN x ON x.tenant = s.tenant AND x.session_id = s.session_id
ORDER BY 3 DESC, 1, 2 LIMIT 100
""")
def session_lru(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by their last turn or look; views of the events table stand for looks."""
    user = F.col("user_id")
    reads = read_table(spark, folder, "events").where("event_type = 'view'").select(
        F.concat(F.lit("t"), (user % 3).cast("string")).alias("tenant"), (user % 40).cast("string").alias("session_id"), F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("at")
    )
    return E.live_sessions(episodes(spark, folder), reads=reads)


@query(f"WITH {_VERSIONS} SELECT id, tenant, subject, predicate, object, valid_from, valid_until, confidence, superseded_by, CASE WHEN valid_until IS NULL THEN 'current' ELSE 'invalidated' END AS status FROM facts")
def fact_view(spark: SparkSession, folder: str) -> DataFrame:
    return reports.shown_facts(facts(spark, folder))


@query(f"WITH {_EPISODES} SELECT id, CASE WHEN surprise IS NOT NULL THEN salience END AS salience, archived FROM episodes")
def episode_view(spark: SparkSession, folder: str) -> DataFrame:
    return E.shown(episodes(spark, folder)).select("id", "salience", "archived")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL ELSE text END AS content,
  CASE doc_id % 5 WHEN 4 THEN 'robot' ELSE 'user' END AS role, CASE WHEN doc_id % 11 = 0 THEN repeat('s', 257) END AS session_id,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS tenant FROM documents)
SELECT doc_id, CASE WHEN content IS NULL OR length(content) < 1 THEN 'content empty' WHEN length(content) > 32000 THEN 'content too long'
  WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role unknown' WHEN length(session_id) > 256 THEN 'session too long'
  WHEN tenant IS NULL OR length(tenant) < 1 OR length(tenant) > 128 THEN 'tenant length' END AS reject FROM d
""")
def input_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")
    rows = read_table(spark, folder, "documents").select(
        n, F.when(n % 9 == 0, "").when(n % 13 == 0, None).otherwise(F.col("text")).alias("content"), F.when(n % 5 == 4, "robot").otherwise("user").alias("role"),
        F.when(n % 11 == 0, F.repeat(F.lit("s"), 257)).alias("session_id"), F.when(n % 17 == 0, "").otherwise(F.col("source")).alias("tenant"),
    )
    return E.quarantine(rows).select("doc_id", "reject")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, 'user') AS tenant FROM documents")
def tenant_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a table from before tenants, a third of which name one."""
    rows = read_table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("tenant"))
    return files.with_tenant(rows)


def _view_sql() -> str:
    """The search of hybrid_search_post with the parts of its score."""
    head, _, tail = _hybrid_sql(False).rpartition("SELECT e.id, round(")
    return f"""{head}SELECT e.id, CASE WHEN surprise IS NOT NULL THEN salience END AS salience, archived, round(dense, 6) AS dense_sim,
  round(1e0 - {_APART.format("c.code", "qc.code")} / 256e0, 6) AS sparse_sim, round(pow(2e0, -greatest(0e0, ({NOW} - created_at) / 86400000e0) / 30e0), 6) AS recency {tail[tail.index("FROM near n"):]}"""


@query(_view_sql())
def scored_episode_view(spark: SparkSession, folder: str) -> DataFrame:
    found = E.search(episodes(spark, folder), vectors(spark, folder), None, asked_vector(spark, folder), QUESTION, NOW, SETTINGS, 10, "post", tenant="t1", min_salience=0.2)
    return reports.scored_episodes(found).select("id", "salience", "archived", *(F.round(c, 6).alias(c) for c in ("dense_sim", "sparse_sim", "recency")))


# -- model output -----------------------------------------------------------------------------------


@query(f"""
WITH raw AS ({A.for_duckdb(A.RAW_SALIENCE)}), j AS (SELECT id, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS raw FROM raw),
n AS (SELECT id, {", ".join(f"TRY_CAST(json_extract_string(raw, '$.{k}') AS DOUBLE) AS {k}" for k in salience.SCORES)} FROM j),
c AS (SELECT id, surprise IS NOT NULL AND arousal IS NOT NULL AND self_ref IS NOT NULL AND recurrence IS NOT NULL AS good,
  {", ".join(f"least(1e0, greatest(0e0, {k})) AS {k}" for k in salience.SCORES)} FROM n)
SELECT id, {", ".join(f"CASE WHEN good THEN {k} ELSE 0.5e0 END AS {k}" for k in salience.SCORES)},
  round(CASE WHEN good THEN greatest(0.4e0 * surprise + 0.3e0 * self_ref + 0.2e0 * arousal + 0.1e0 * recurrence, self_ref) ELSE 0.5e0 END, 6) AS salience FROM c
""")
def salience_parse(spark: SparkSession, folder: str) -> DataFrame:
    found = salience.parse(A.adapted(spark, folder, A.RAW_SALIENCE))
    return found.select("id", *salience.SCORES, F.round("salience", 6).alias("salience"))


_JSON = f"raw AS ({A.for_duckdb(A.RAW_EXTRACTIONS)}), j AS (SELECT id, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS raw FROM raw)"


@query(f"""
WITH {_JSON}, f AS (SELECT id, unnest(json_extract(raw, '$.facts')::JSON[]) AS f, unnest(range(len(json_extract(raw, '$.facts')::JSON[])))::INTEGER AS position FROM j),
g AS (SELECT id, position, trim(json_extract_string(f, '$.subject')) AS subject, json_extract_string(f, '$.predicate') AS predicate, trim(json_extract_string(f, '$.object')) AS object,
  CASE WHEN json_extract_string(f, '$.confidence') IS NULL THEN 1e0 ELSE TRY_CAST(json_extract_string(f, '$.confidence') AS DOUBLE) END AS confidence FROM f)
SELECT * FROM g WHERE subject <> '' AND object <> '' AND predicate IS NOT NULL AND confidence BETWEEN 0 AND 1
""")
def extraction_validate(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.raw_facts(A.adapted(spark, folder, A.RAW_EXTRACTIONS))


@query(f"""
WITH {_JSON}, e AS (SELECT id, unnest(json_extract(raw, '$.entities')::JSON[]) AS e, unnest(range(len(json_extract(raw, '$.entities')::JSON[])))::INTEGER AS position FROM j),
g AS (SELECT id, position, trim(json_extract_string(e, '$.name')) AS name, lower(trim(json_extract_string(e, '$.entity_type'))) AS kind,
  list_filter(list_transform(coalesce(from_json(json_extract(e, '$.aliases'), '["VARCHAR"]'), []), lambda x: trim(x)), lambda x: x <> '') AS aliases FROM e)
SELECT id, position, name, CASE WHEN kind IN ('{"', '".join(ENTITY_TYPES)}') THEN kind END AS entity_type, array_to_string(aliases, ',') AS aliases FROM g WHERE name <> ''
""")
def extraction_entities(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.raw_entities(A.adapted(spark, folder, A.RAW_EXTRACTIONS))
    return found.select("id", "position", "name", "entity_type", _joined("aliases"))


_SPELLINGS = (" Works_At", "lives_in ", "PREFERS", "work_at", "likes", "owner", "has goal", "")


@query(f"""
WITH s AS (SELECT doc_id, {list(_SPELLINGS)!r}[(doc_id % {len(_SPELLINGS)} + 1)::INTEGER] AS raw FROM documents)
SELECT doc_id, CASE WHEN lower(trim(raw)) IN ({_NAMES}) THEN lower(trim(raw)) END AS predicate FROM s
""")
def predicate_exact_map(spark: SparkSession, folder: str) -> DataFrame:
    spellings = F.array(*map(F.lit, _SPELLINGS))
    raw = F.element_at(spellings, (F.col("doc_id") % len(_SPELLINGS) + 1).cast("int"))
    return read_table(spark, folder, "documents").select("doc_id", extraction.exact_predicate(raw).alias("predicate"))


@query()
def predicate_fuzzy_map(spark: SparkSession, folder: str) -> DataFrame:
    spellings = F.array(*map(F.lit, _SPELLINGS))
    raw = F.element_at(spellings, (F.col("doc_id") % len(_SPELLINGS) + 1).cast("int"))
    rows = read_table(spark, folder, "documents").select("doc_id", raw.alias("predicate"), F.lit("thing").alias("object"))
    return extraction.map_predicates(rows)


@query()
def sparse_code_blake2b(spark: SparkSession, folder: str) -> DataFrame:
    return episodes(spark, folder).select("id", F.array_join(V.sparse_code_blake(F.col("content"), F.col("created_at")), ",").alias("code"))


# -- questions --------------------------------------------------------------------------------------

QUESTIONS = (
    "où on en est ?", "résume la conversation", "what's the current status?", "comment je fais pour déployer ?", "how to export the database?",
    "comment ma préférence a évolué ?", "history of my jobs", "mon adresse a changé", "quand ai-je commencé ?", "what happened YESTERDAY?",
    "hier et résume", "j'ai dit quoi sur le budget ?", "did we talk about it?", "qu'est-ce que tu sais sur Tom ?", "who is Tom?", "le thé vert",
    "", "thier", "avant je vivais ici, maintenant ailleurs", "Récapitulons",
)


def _re2(pattern: str) -> str:
    """The pattern with word boundaries spelt out, of which RE2 only knows ASCII ones."""
    edge = r"[^\p{L}\p{N}_]"
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|{edge})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|{edge})"
    return pattern


_TYPES = " ".join(f"WHEN regexp_matches(q, {_quoted('(?i)' + '|'.join(map(_re2, patterns)))}) THEN '{name}'" for name, patterns in QUESTION_PATTERNS)


@query(f"""
WITH s AS (SELECT doc_id, [{", ".join(map(_quoted, QUESTIONS))}][(doc_id % {len(QUESTIONS)} + 1)::INTEGER] AS q FROM documents)
SELECT doc_id, q, CASE {_TYPES} ELSE 'unknown' END AS type FROM s
""")
def router_classify(spark: SparkSession, folder: str) -> DataFrame:
    q = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("doc_id") % len(QUESTIONS) + 1).cast("int"))
    return router.classified(read_table(spark, folder, "documents").select("doc_id", q.alias("q")))


@query(f"WITH {_EPISODES}, s AS (SELECT id, content AS q FROM episodes) SELECT id, CASE {_TYPES} ELSE 'unknown' END AS type FROM s")
def router_classify_turns(spark: SparkSession, folder: str) -> DataFrame:
    return router.classified(episodes(spark, folder).select("id", F.col("content").alias("q"))).drop("q")


#: A question of each type.
ASKED_FOR = (
    "where are we with it", "how to use the blue economy brand#1", "history of my jobs", "what happened yesterday", "did we talk about la le", "who is item 3", "le the vert",
)
SESSION, K_HITS = "7", 5


def _code_sql(question: str) -> str:
    """The hash code of a question asked now."""
    tokens = _FIRST.format(_TOKENS.format(_quoted(question)))
    at = f"DATE '1970-01-01' + ({NOW} // 86400000)::INTEGER"
    bucket = f"year({at}) || '-W' || weekofyear({at}) || '-' || (isodow({at}) - 1) || '-' || (({NOW} // 3600000) % 24) // 4"
    return f"""SELECT list_transform(range(7), lambda k: coalesce(m[k::INTEGER], 0)) || [('0x' || substr(md5({bucket}), 1, 8))::BIGINT] AS code
      FROM (SELECT map(list(n::INTEGER), list(v)) AS m FROM (SELECT p // 32 AS n, sum(1::BIGINT << (p % 32))::BIGINT AS v
        FROM (SELECT DISTINCT ('0x' || substr(md5(w), 1, 4))::BIGINT % 224 AS p FROM (SELECT unnest({tokens}) AS w)) GROUP BY ALL))"""


def _search_sql(question: str, held: str, k: int) -> str:
    """The best episodes for a question, filtered after the nearest."""
    score = f"""0.7e0 * dense + 0.3e0 * (1e0 - {_APART.format("c.code", "qc.code")} / 256e0) + 0.1e0 * pow(2e0, -greatest(0e0, ({NOW} - created_at) / 86400000e0) / 30e0)"""
    return f"""SELECT e.*, row_number() OVER (ORDER BY {score} DESC, e.id)::INTEGER AS rank
  FROM near_episodes n JOIN episodes e ON e.id = n.id JOIN code c ON c.id = n.id, ({_code_sql(question)}) qc
  WHERE tenant = 't1' AND NOT archived AND {held} QUALIFY rank <= {k}"""


_DAY = "strftime(DATE '1970-01-01' + ({0} // 86400000)::INTEGER, '%Y-%m-%d')"
_FACT_LINE = "'  • ' || subject || ' — ' || predicate || ' — ' || object || CASE WHEN valid_until IS NULL THEN '' ELSE ' [invalidé]' END"


def _routed_sql() -> str:
    """Lines of the answers to ASKED_FOR."""
    parts = []
    for n, question in enumerate(ASKED_FOR):
        kind = router.classify(question)
        words = sorted({w for w in question.lower().split() if len(w) > 2})
        hits = " + ".join(f"contains(lower(name || ' ' || desc_), {_quoted(w)})::INTEGER" for w in words)
        own = {
            "facts": f"SELECT rank, {_FACT_LINE} || ' (score ' || printf('%.2f', similarity) || ')' AS line FROM hits",
            "history": f"SELECT rank, {_FACT_LINE} || ' (' || {_DAY.format('valid_from')} || ')' AS line FROM past_of_hits",
            "episodes": f"SELECT rank, '  • [' || {_DAY.format('created_at')} || '] ' || content AS line FROM ({_search_sql(question, f'session_id = {_quoted(SESSION)}', K_HITS)})",
            "working": f"SELECT position AS rank, '  • ' || content AS line FROM items WHERE tenant = 't1' AND session_id = {_quoted(SESSION)}",
            "procedural": f"SELECT 0 AS rank, 'Skills : ' || string_agg(name, ', ' ORDER BY h DESC, position) AS line FROM (SELECT *, {hits} AS h FROM skills WHERE {hits} > 0 ORDER BY h DESC, position LIMIT 5) HAVING count(*) > 0",
        }
        body = []
        for section, name in enumerate(router.HEADINGS, 1):
            if name in router.STORES[kind]:
                body.append(f"SELECT ({section * 1_000_000} + rank)::INTEGER AS place, line FROM ({own[name]})")
                if name != "procedural":
                    body.append(f"SELECT {section * 1_000_000} AS place, {_quoted(router.HEADINGS[name])} AS line WHERE EXISTS ({own[name]})")
        whole = " UNION ALL ".join(body)
        parts.append(f"SELECT {n} AS question, 0 AS place, '[route : {kind}]' AS line UNION ALL SELECT {n}, place, line FROM ({whole}) UNION ALL SELECT {n}, 1, {_quoted(router.NOTHING)} WHERE NOT EXISTS ({whole})")
    return f"""
WITH {_EPISODES}, {_CODES}, {_VERSIONS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = {ASKED}), skills AS ({A.for_duckdb(A.SKILLS)}),
near_episodes AS (
  SELECT e.id, {_COSINE.format("v.embedding", "q.embedding")} AS dense FROM episodes e JOIN embeddings v ON v.vec_id = e.vec_id, q ORDER BY dense DESC, e.id LIMIT 50
), near_facts AS (
  SELECT f.id, {_COSINE.format("e.embedding", "q.embedding")} AS similarity
  FROM facts f JOIN embeddings e ON e.vec_id = f.seq % (SELECT count(*) FROM embeddings), q ORDER BY similarity DESC, f.id LIMIT {4 * K_HITS}
), hits AS (
  SELECT f.*, n.similarity, row_number() OVER (ORDER BY n.similarity DESC, f.id)::INTEGER AS rank FROM near_facts n JOIN facts f ON f.id = n.id
  WHERE tenant = 't1' AND valid_until IS NULL QUALIFY rank <= {K_HITS}
), pairs AS (SELECT skey, predicate, min(rank) AS first FROM hits GROUP BY ALL),
past_of_hits AS (
  SELECT f.*, row_number() OVER (ORDER BY first, valid_from, seq)::INTEGER AS rank FROM facts f JOIN pairs p ON p.skey = f.skey AND p.predicate = f.predicate WHERE tenant = 't1'
), items AS (
  SELECT *, (least(n, 5) - back + 1)::INTEGER AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant, session_id ORDER BY created_at DESC, id DESC) AS back, count(*) OVER (PARTITION BY tenant, session_id) AS n FROM episodes) WHERE back <= 5
)
{" UNION ALL ".join(parts)}
"""


def memory(spark: SparkSession, folder: str) -> router.Memory:
    every = written(facts(spark, folder), "facts")
    known = A.adapted(spark, folder, A.SKILLS).withColumnRenamed("desc_", "desc")
    return router.Memory(episodes(spark, folder), vectors(spark, folder), every, fact_vectors(spark, folder, every), known)


@query(_routed_sql())
def routed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered answer to a question of each type."""
    own, asked, out = memory(spark, folder), asked_vector(spark, folder), None
    for n, question in enumerate(ASKED_FOR):
        found = router.answer(own, question, asked, "t1", NOW, SETTINGS, SESSION, K_HITS)
        part = router.rendered(question, found).select(F.lit(n).alias("question"), "place", "line")
        out = part if out is None else out.unionByName(part)
    return out


# -- skills -----------------------------------------------------------------------------------------


@query(f"""
WITH s AS ({A.for_duckdb(A.SKILLS)}), t AS (SELECT unnest(['blue', 'bolt', 'economy', 'brand#1']) AS t),
h AS (SELECT name, position, count(*) AS hits FROM s JOIN t ON contains(lower(name || ' ' || desc_), t) GROUP BY ALL)
SELECT name, hits::INTEGER AS hits FROM h ORDER BY h.hits DESC, position LIMIT 5
""")
def skill_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.adapted(spark, folder, A.SKILLS).withColumnRenamed("desc_", "desc")
    return skills.search(rows, "Blue bolt of ECONOMY brand#1 bolt").select("name", "hits")


@query(f"WITH s AS ({A.for_duckdb(A.SKILLS)}) SELECT replace(p_name, ' ', '_') AS name, max(p_partkey) AS seq, min(p_partkey) AS position FROM part WHERE p_name NOT LIKE '%&%' GROUP BY 1")
def skill_registry(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "part").select(F.col("p_partkey").alias("seq"), F.regexp_replace("p_name", " ", "_").alias("name"))
    return skills.register(rows).select("name", "seq", "position")


@query(f"""
WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq, success) AS n FROM ({A.for_duckdb(A.USES)})),
fold AS (
  SELECT name, 0::BIGINT AS n, 1e0 AS rate, NULL::BIGINT AS ts FROM u WHERE n = 1
  UNION ALL SELECT f.name, u.n, floor((f.rate * f.n + u.success::INT) / (f.n + 1) * 10000e0 + 0.5e0) / 10000e0, u.ts FROM fold f JOIN u ON u.name = f.name AND u.n = f.n + 1
)
SELECT name, arg_max(rate, n) AS success_rate, max(n) AS uses, max(ts) AS last_used_at FROM fold GROUP BY name
""")
def skill_success_rate(spark: SparkSession, folder: str) -> DataFrame:
    return skills.success_rates(A.adapted(spark, folder, A.USES))


# -- graph ------------------------------------------------------------------------------------------


def _case(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in table.items())} ELSE {default} END"


def _month(ms: str) -> str:
    day = f"(DATE '1970-01-01' + ({ms} // 86400000)::INTEGER)"
    return f"[{', '.join(map(_quoted, MONTHS))}][month({day})] || ' ' || year({day})"


_GRAPH = f"""
{_VERSIONS}, known AS (SELECT lower(canonical_name) AS k, min(canonical_name) AS known FROM ({A.for_duckdb(A.GRAPH_ENTITIES)}) WHERE tenant = 't1' GROUP BY 1),
around AS (
  SELECT f.*, known, coalesce(known, 'c:' || lower(object)) AS object_id, {_case("predicate", LINK_FAMILIES, "'projet'")} AS family
  FROM facts f LEFT JOIN known ON k = lower(object) WHERE tenant = 't1' AND skey = 'user_1' AND valid_until IS NULL
), walk AS (
  SELECT id AS chain, object_id, id, 0 AS steps FROM around
  UNION ALL SELECT w.chain, w.object_id, f.id, w.steps + 1 FROM walk w JOIN facts f ON f.superseded_by = w.id
), past AS (SELECT w.chain, w.object_id, steps, object, valid_from, valid_until, known AS entity FROM walk w JOIN facts f ON f.id = w.id LEFT JOIN known ON k = lower(object) WHERE steps > 0)
"""


def _graph(spark: SparkSession, folder: str, build: Callable) -> DataFrame:
    own = written(facts(spark, folder).where("tenant = 't1'"), "graph-facts")  # several parts of the graph read them
    return build(own, A.adapted(spark, folder, A.GRAPH_ENTITIES), "t1", SETTINGS)


@query(f"""
WITH RECURSIVE {_GRAPH}
SELECT 'f:' || id AS id, {_case("predicate", PREDICATE_LABELS, "predicate")} AS predicate, object_id, family AS type, {_month("valid_from")} AS since,
  'confiance ' || round_even(confidence * 100, 0)::INTEGER || '%' AS detail FROM around
""")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder, graph.edges)


@query(f"""
WITH RECURSIVE {_GRAPH}
SELECT 'f:' || chain AS fact_id, object_id, steps::INTEGER AS steps, object AS value, entity, {_month("valid_from")} AS from_month, {_month("coalesce(valid_until, valid_from)")} AS to_month FROM past
""")
def graph_history(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder, graph.edge_history).drop("valid_from")


@query(f"""
WITH RECURSIVE {_GRAPH}, c AS (
  SELECT object_id, arg_min(object, seq) AS object, arg_min(CASE family WHEN 'localisation' THEN 'lieu' WHEN 'emploi' THEN 'organisation' ELSE 'projet' END, seq) AS type
  FROM around WHERE known IS NULL GROUP BY object_id)
SELECT object_id AS id, type, object AS label, 1::BIGINT AS mentions FROM c
""")
def graph_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder, graph.concepts)


_WIDE = _GRAPH.replace(_LOG, f"log AS ({A.for_duckdb(A.WIDE_LOG)})").replace(A.for_duckdb(A.GRAPH_ENTITIES), A.for_duckdb(A.ITEMS))


@query(f"""
WITH RECURSIVE {_WIDE}
SELECT entity, arg_max(object_id, (valid_from, 'f:' || chain)) AS tether FROM past
WHERE entity IS NOT NULL AND lower(entity) NOT IN (SELECT lower(object) FROM facts WHERE tenant = 't1' AND valid_until IS NULL) GROUP BY entity
""")
def graph_ghosts(spark: SparkSession, folder: str) -> DataFrame:
    own = written(K.versions(A.adapted(spark, folder, A.WIDE_LOG)).where("tenant = 't1'"), "graph-facts")
    return graph.ghosts(own, A.adapted(spark, folder, A.ITEMS), "t1", SETTINGS)


@query(f"""
WITH RECURSIVE {_GRAPH}, g AS (
  SELECT entity, arg_max(object_id, (valid_from, 'f:' || chain)) AS tether FROM past
  WHERE entity IS NOT NULL AND lower(entity) NOT IN (SELECT lower(object) FROM facts WHERE tenant = 't1' AND valid_until IS NULL) GROUP BY entity)
SELECT canonical_name AS id, {_case("coalesce(entity_type, '')", ENTITY_LABELS, "'projet'")} AS type, canonical_name AS label, greatest(1, episode_count)::BIGINT AS mentions,
  tether IS NOT NULL AS expired, tether FROM ({A.for_duckdb(A.GRAPH_ENTITIES)}) e LEFT JOIN g ON g.entity = e.canonical_name WHERE e.tenant = 't1'
UNION ALL
SELECT object_id, arg_min(CASE family WHEN 'localisation' THEN 'lieu' WHEN 'emploi' THEN 'organisation' ELSE 'projet' END, seq), arg_min(object, seq), 1, NULL, NULL
FROM around WHERE known IS NULL GROUP BY object_id
""")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder, graph.nodes)


@query(f"""
WITH {_EPISODES}, known AS (SELECT lower(canonical_name) AS k, min(canonical_name) AS known FROM ({A.for_duckdb(A.GRAPH_ENTITIES)}) WHERE tenant = 't1' GROUP BY 1),
n AS (SELECT * FROM episodes WHERE tenant = 't1' AND NOT archived ORDER BY created_at DESC, id DESC LIMIT 300),
r AS (SELECT id, unnest(entity_refs) AS ref, unnest(range(len(entity_refs))) AS pos FROM n),
a AS (SELECT id, arg_min(known, pos) AS anchor FROM r JOIN known ON k = lower(ref) GROUP BY id)
SELECT 'm:' || n.id AS id, CASE WHEN length(content) > 90 THEN substr(content, 1, 89) || '…' ELSE content END AS label,
  day(DATE '1970-01-01' + (created_at // 86400000)::INTEGER) || ' ' || {_month("created_at")} AS date, round(decay_state, 3) AS freshness, round(salience, 3) AS importance, anchor
FROM n LEFT JOIN a ON a.id = n.id
""")
def graph_memories(spark: SparkSession, folder: str) -> DataFrame:
    return graph.memories(episodes(spark, folder), A.adapted(spark, folder, A.GRAPH_ENTITIES), "t1", SETTINGS)


# -- reports ----------------------------------------------------------------------------------------


@query(f"""
WITH {_EPISODES}, {_VERSIONS}
SELECT 'episode' AS type, id, content AS line FROM episodes
UNION ALL SELECT 'fact', id, subject || ' ' || predicate || ' ' || object FROM facts
""")
def episode_export(spark: SparkSession, folder: str) -> DataFrame:
    lines = files.export_lines(
        episodes(spark, folder).select("id", F.col("content").alias("line")), facts(spark, folder).select("id", F.concat_ws(" ", "subject", "predicate", "object").alias("line"))
    )
    return lines.select(F.from_json("value", "type string, data struct<id: string, line: string>").alias("r")).select("r.type", "r.data.*")


@query(f"""
WITH {_EPISODES}, {_VERSIONS}
SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM episodes WHERE consolidated_at IS NOT NULL) AS consolidated, (SELECT count(*) FROM episodes WHERE archived) AS archived,
  (SELECT count(*) FROM facts WHERE valid_until IS NULL) AS current_facts, (SELECT count(*) FROM facts WHERE valid_until IS NOT NULL) AS past_facts,
  (SELECT count(*) FROM supplier) AS entities, (SELECT count(*) FROM part) AS skills,
  (SELECT count(*) FROM (SELECT 1 FROM facts WHERE valid_until IS NULL GROUP BY tenant, skey, predicate, lower(object) HAVING count(*) > 1)) AS duplicates
""")
def stats(spark: SparkSession, folder: str) -> DataFrame:
    one = F.lit(1).alias("_one")
    of_episodes = episodes(spark, folder).agg(F.count("*").alias("episodes"), F.count("consolidated_at").alias("consolidated"), F.count_if("archived").alias("archived"))
    counts = [read_table(spark, folder, t).agg(F.count("*").alias(n)) for t, n in (("supplier", "entities"), ("part", "skills"))]
    out = of_episodes.select("*", one)
    for part in (K.totals(facts(spark, folder)), *counts):  # one row each
        out = out.join(part.select("*", one), "_one")
    return out.drop("_one")


_OVERLAP = f"""
t AS (SELECT x, list_distinct(list_filter({_TOKENS.format("x")}, lambda w: length(w) > 2)) AS t FROM (SELECT object AS x FROM refs UNION SELECT object FROM found)),
kin AS (SELECT unnest({[k for k, v in PREDICATE_KIN.items() for _ in v]!r}) AS p, unnest({[x for v in PREDICATE_KIN.values() for x in v]!r}) AS q),
pairs AS (
  SELECT r.ref_id, f.position, f.object, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) AS score
  FROM refs r JOIN kin ON p = r.predicate JOIN found f ON f.predicate = q JOIN t a ON a.x = r.object JOIN t b ON b.x = f.object
  WHERE (lower(r.subject) = lower(f.subject) OR contains(lower(f.subject), 'user')) AND len(a.t) > 0 AND len(b.t) > 0
), best AS (SELECT ref_id, arg_max((position, object, score), (score, -position)) AS b FROM pairs WHERE score >= 0.4 GROUP BY ref_id)"""
_RECALL = f"WITH refs AS ({A.for_duckdb(A.REFERENCE_FACTS)}), found AS ({A.for_duckdb(A.FOUND_FACTS)}), {_OVERLAP}"


@query(f"{_RECALL} SELECT r.ref_id, predicate, b[1] AS position, b[2] AS found, round(b[3], 6) AS score FROM refs r LEFT JOIN best x ON x.ref_id = r.ref_id")
def recall_matches(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluation.fuzzy_matches(A.adapted(spark, folder, A.REFERENCE_FACTS), A.adapted(spark, folder, A.FOUND_FACTS))
    return found.withColumn("score", F.round("score", 6))


@query(f"{_RECALL} SELECT (SELECT count(*) FROM best) AS found, (SELECT count(*) FROM refs) AS total")
def recall_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.recall(A.adapted(spark, folder, A.REFERENCE_FACTS), A.adapted(spark, folder, A.FOUND_FACTS))


@query(f"""
WITH refs AS ({A.for_duckdb(A.REFERENCE_FACTS)}), found AS ({A.for_duckdb(A.FOUND_FACTS)}),
kin AS (SELECT unnest({[k for k, v in PREDICATE_KIN.items() for _ in v]!r}) AS p, unnest({[x for v in PREDICATE_KIN.values() for x in v]!r}) AS q
  UNION ALL SELECT 'loves', 'loves')
SELECT r.ref_id AS gold_id, coalesce(bool_or(contains(lower(f.subject), 'user') AND (contains(lower(f.object), lower(left(r.object, 7))) OR contains(lower(left(r.object, 7)), lower(f.object)))), false) AS hit
FROM refs r JOIN kin ON p = r.predicate LEFT JOIN found f ON f.predicate = q AND f.position // 10 = r.ref_id // 150 GROUP BY r.ref_id
""")
def gold_matches(spark: SparkSession, folder: str) -> DataFrame:
    gold = A.adapted(spark, folder, A.REFERENCE_FACTS).select(
        F.col("ref_id").alias("gold_id"), F.floor(F.col("ref_id") / 150).alias("episode"), F.lit("user").alias("subject"), "predicate", F.lower(F.substring("object", 1, 7)).alias("object")
    )
    found = A.adapted(spark, folder, A.FOUND_FACTS).withColumn("episode", F.floor(F.col("position") / 10))
    return evaluation.gold_matches(gold, found).select("gold_id", "hit")


@query(f"""
WITH {_JSON}, k AS (SELECT id, CAST(id AS BIGINT) // 1000 * 8 + CAST(id AS BIGINT) % 1000 AS n FROM raw),
told AS (SELECT j.id, json_valid(raw.raw) AS ok, coalesce(len(json_extract(j.raw, '$.facts')::JSON[]), 0) AS n FROM j JOIN raw ON raw.id = j.id),
f AS (SELECT id, unnest(json_extract(raw, '$.facts')::JSON[]) AS f FROM j),
g AS (SELECT id, lower(json_extract_string(f, '$.subject')) AS s, lower(json_extract_string(f, '$.predicate')) AS p, lower(json_extract_string(f, '$.object')) AS o FROM f),
gold AS (
  SELECT id, 's' AS s, 'has_goal' AS p, 'g' AS o, false AS trap FROM k WHERE n % 7 IN (5, 6) UNION ALL SELECT id, 't', 'knows_about', 'y', false FROM k WHERE n % 7 = 2
  UNION ALL SELECT id, 's', 'owns', 'x', true FROM k WHERE n % 7 IN (2, 4)
), kin AS (SELECT unnest({[k for k, v in PREDICATE_KIN.items() for _ in v]!r}) AS p, unnest({[x for v in PREDICATE_KIN.values() for x in v]!r}) AS q),
hit AS (SELECT gold.*, EXISTS (SELECT 1 FROM kin JOIN g ON g.p = kin.q WHERE kin.p = gold.p AND g.id = gold.id AND contains(g.s, gold.s) AND (contains(g.o, gold.o) OR contains(gold.o, g.o))) AS hit FROM gold),
wanted AS (SELECT id, count(*) AS wanted FROM gold WHERE NOT trap GROUP BY id)
SELECT (SELECT count(*) FILTER (WHERE ok) FROM told) AS valid, (SELECT count(*) FROM told) AS episodes,
  (SELECT count(*) FROM told JOIN k ON k.id = told.id WHERE k.n % 7 IN (3, 5) AND ok AND told.n = 0) AS silence, (SELECT count(*) FROM k WHERE n % 7 IN (3, 5)) AS silent,
  (SELECT coalesce(sum(greatest(0, n - wanted - 1)), 0)::BIGINT FROM told JOIN wanted ON wanted.id = told.id) AS extra,
  (SELECT count(*) FROM hit WHERE hit AND NOT trap) AS recalled, (SELECT count(*) FROM hit WHERE NOT trap) AS gold, (SELECT count(*) FROM hit WHERE hit AND trap) AS trapped,
  (SELECT count(*) FROM hit WHERE trap) AS traps, (SELECT count(*) FROM g WHERE coalesce(p, '') NOT IN ({_NAMES})) AS odd
""")
def extraction_metrics(spark: SparkSession, folder: str) -> DataFrame:
    raw = A.adapted(spark, folder, A.RAW_EXTRACTIONS).withColumnRenamed("id", "episode")
    n = (F.floor(F.col("episode").cast("long") / 1000) * 8 + F.col("episode").cast("long") % 1000) % 7
    expected = raw.select("episode", n.isin(3, 5).alias("silent"))
    sought = [("s", "has_goal", "g", False, (5, 6)), ("t", "knows_about", "y", False, (2,)), ("s", "owns", "x", True, (2, 4))]
    each = F.array(*(F.when(n.isin(*on), F.struct(F.lit(s).alias("subject"), F.lit(p).alias("predicate"), F.lit(o).alias("object"), F.lit(t).alias("trap"))) for s, p, o, t, on in sought))
    gold = raw.select("episode", F.posexplode(F.filter(each, lambda x: x.isNotNull())).alias("pos", "g")).select(F.concat_ws(":", "episode", "pos").alias("gold_id"), "episode", "g.*")
    return evaluation.extraction_metrics(expected, gold, raw)


@query(f"""
{_RECALL} SELECT row_number() OVER (PARTITION BY b IS NULL, predicate ORDER BY object, r.ref_id)::INTEGER AS place, r.ref_id, predicate, object, b IS NOT NULL AS is_found, b[2] AS found
FROM refs r LEFT JOIN best x ON x.ref_id = r.ref_id WHERE predicate IN ({_NAMES})
""")
def import_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.import_report(A.adapted(spark, folder, A.REFERENCE_FACTS), A.adapted(spark, folder, A.FOUND_FACTS))


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(avg(value), 6) AS mean, max(value) AS longest FROM events GROUP BY event_type")
def latency_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = evaluation.latency(read_table(spark, folder, "events"), "event_type", "value")
    return found.withColumns({"p50": F.round("p50", 6), "mean": F.round("mean", 6)})


@query(f"""
WITH {_EPISODES}, s AS (SELECT CASE WHEN role = 'user' THEN 'high' ELSE 'low' END AS expected, * FROM episodes)
SELECT count(*) FILTER (WHERE expected = 'high' AND self_ref >= 0.5) AS high_ok, count(*) FILTER (WHERE expected = 'high') AS high,
  count(*) FILTER (WHERE expected = 'low' AND salience < 0.6) AS low_ok, count(*) FILTER (WHERE expected = 'low') AS low FROM s
""")
def salience_plausibility(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.plausibility(episodes(spark, folder).withColumn("expected", F.when(F.col("role") == "user", "high").otherwise("low")))


@query(f"""
WITH {_EPISODES}, {_VERSIONS}
SELECT id, '  • [' || {_DAY.format("created_at")} || '] ' || content AS line FROM episodes WHERE tenant = 't1'
UNION ALL
SELECT id, '  • ' || subject || ' — ' || predicate || ' — ' || object || CASE WHEN valid_until IS NULL THEN '' ELSE ' [invalidé]' END || ' (' || {_DAY.format("valid_from")} || ')' FROM facts WHERE tenant = 't1'
""")
def answer_lines(spark: SparkSession, folder: str) -> DataFrame:
    own = reports.episode_lines(E.matching(episodes(spark, folder), "t1", include_archived=True))
    return own.select("id", "line").union(reports.history_lines(facts(spark, folder).where("tenant = 't1'")).select("id", "line"))


@query(f"""
WITH {_EPISODES}, {_VERSIONS}, d AS (SELECT *, surprise IS NOT NULL AND NOT archived AND consolidated_at IS NULL AND salience > 0.6 AS due FROM episodes),
x AS (SELECT 1 FROM facts WHERE valid_until IS NULL GROUP BY tenant, skey, predicate, lower(object) HAVING count(*) > 1)
SELECT count(*) FILTER (WHERE surprise IS NULL AND NOT archived) AS unscored, count(*) FILTER (WHERE due AND created_at <= {NOW} - 3600000) AS ready,
  count(*) FILTER (WHERE due AND created_at > {NOW} - 3600000) AS waiting, (SELECT count(*) FROM x) AS duplicates, (SELECT count(*) FROM x) = 0 AS ok FROM d
""")
def health(spark: SparkSession, folder: str) -> DataFrame:
    return reports.health(episodes(spark, folder), facts(spark, folder), NOW, SETTINGS)


@query(f"""
WITH {_EPISODES}, {_CODES}, {_VERSIONS}, q AS (SELECT embedding FROM embeddings WHERE vec_id = {ASKED}),
near_episodes AS (
  SELECT e.id, {_COSINE.format("v.embedding", "q.embedding")} AS dense FROM episodes e JOIN embeddings v ON v.vec_id = e.vec_id, q ORDER BY dense DESC, e.id LIMIT 50
), near_facts AS (
  SELECT f.id, {_COSINE.format("e.embedding", "q.embedding")} AS similarity
  FROM facts f JOIN embeddings e ON e.vec_id = f.seq % (SELECT count(*) FROM embeddings), q ORDER BY similarity DESC, f.id LIMIT {4 * K_HITS}
), e AS (SELECT *, CASE WHEN role = 'user' THEN 'fact' ELSE 'noise' END AS kind FROM episodes)
SELECT 'one current value' AS "check", NOT EXISTS (SELECT 1 FROM facts WHERE valid_until IS NULL AND slot = '' GROUP BY tenant, skey, predicate HAVING count(*) > 1) AS ok
UNION ALL SELECT 'closed when superseded', NOT EXISTS (SELECT 1 FROM facts WHERE superseded_by IS NOT NULL AND valid_until IS NULL)
UNION ALL SELECT 'no duplicates', NOT EXISTS (SELECT 1 FROM facts WHERE valid_until IS NULL GROUP BY tenant, skey, predicate, lower(object) HAVING count(*) > 1)
UNION ALL SELECT 'noise stays out', count(*) FILTER (WHERE kind = 'noise' AND consolidated_at IS NOT NULL AND NOT extraction_failed) <= 0.2 * count(*) FILTER (WHERE kind = 'noise') FROM e
UNION ALL SELECT 'salience sets apart', count(*) FILTER (WHERE kind = 'fact' AND salience >= 0.6) >= 0.7 * count(*) FILTER (WHERE kind = 'fact')
  AND count(*) FILTER (WHERE kind = 'noise' AND salience < 0.6) >= 0.7 * count(*) FILTER (WHERE kind = 'noise') FROM e
UNION ALL SELECT 'one workplace', count(*) FILTER (WHERE valid_until IS NULL) = 1 AND count(*) FILTER (WHERE valid_until IS NULL AND contains(lower(object), 'item')) = 1
  FROM facts WHERE tenant = 't1' AND skey = 'user_7' AND predicate = 'works_at'
UNION ALL SELECT 'a workplace before', count(*) >= 2 AND count(*) FILTER (WHERE valid_until IS NOT NULL AND superseded_by IS NOT NULL AND contains(lower(object), 'item 1')) > 0
  FROM facts WHERE tenant = 't1' AND skey = 'user_7' AND predicate = 'works_at'
UNION ALL SELECT 'a home before', count(*) >= 2 AND count(*) FILTER (WHERE valid_until IS NOT NULL AND contains(lower(object), 'item')) > 0
  FROM facts WHERE tenant = 't1' AND skey = 'user_7' AND predicate = 'lives_in'
UNION ALL SELECT 'owned: ' || part, count(*) FILTER (WHERE valid_until IS NULL AND contains(lower(object), part)) > 0
  FROM (SELECT unnest(['item 1', 'item 77']) AS part) LEFT JOIN facts ON tenant = 't1' AND skey = 'user_7' AND predicate = 'owns' GROUP BY part
UNION ALL SELECT 'search keeps to its window', count(*) > 0 AND count(*) FILTER (WHERE created_at BETWEEN {WINDOW[0]} AND {WINDOW[1]}) = count(*)
  FROM ({_search_sql("le the vert", f"created_at BETWEEN {WINDOW[0]} AND {WINDOW[1]}", K_HITS)})
UNION ALL SELECT 'open questions ask both stores', (SELECT count(*) > 0 FROM ({_search_sql("item 3", "true", K_HITS)}))
  AND (SELECT count(*) FROM (SELECT f.* FROM near_facts n JOIN facts f ON f.id = n.id WHERE tenant = 't1' AND valid_until IS NULL ORDER BY n.similarity DESC, f.id LIMIT {K_HITS})
    WHERE contains(skey, 'item') OR contains(lower(object), 'item')) > 0
""")
def acceptance_checks(spark: SparkSession, folder: str) -> DataFrame:
    kinds = episodes(spark, folder).withColumn("kind", F.when(F.col("role") == "user", "fact").otherwise("noise"))
    own, asked = memory(spark, folder), asked_vector(spark, folder)
    wanted = [
        ("one workplace", "only", "works_at", "item"), ("a workplace before", "past", "works_at", "item 1"), ("a home before", "ended", "lives_in", "item"),
        ("owned: item 1", "held", "owns", "item 1"), ("owned: item 77", "held", "owns", "item 77"),
    ]
    table = spark.createDataFrame([(c, k, "t1", "user_7", p, o) for c, k, p, o in wanted], "check string, kind string, tenant string, subject string, predicate string, part string")
    early = E.search(own.episodes, own.vectors, None, asked, "le the vert", NOW, SETTINGS, K_HITS, tenant="t1", window=WINDOW)
    both = router.answer(own, "item 3", asked, "t1", NOW, SETTINGS, k=K_HITS)
    checks = [
        reports.acceptance(kinds, own.facts, SETTINGS), reports.expectations(own.facts, table), reports.window_check(early, WINDOW),
        reports.both_check(router.classify("item 3"), both["episodes"], both["facts"], "item"),
    ]
    out = checks[0]
    for part in checks[1:]:
        out = out.union(part)
    return out


@query()
def run_once_report(spark: SparkSession, folder: str) -> DataFrame:
    said = F.concat(F.lit("I works_at item "), F.col("turn_").cast("string"), F.lit("."))
    rows = episodes(spark, folder).withColumn("turn_", F.col("id").cast("long") % 8).withColumn("content", F.when(F.col("role") == "user", said).otherwise(F.col("content")))
    return consolidation.run_once(rows, log(spark, folder), NOW, SETTINGS).report


@query(_WORKING)
def stream_working_memory(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/conversations.parque[t]"  # a pattern: the table may be one file
    schema = read_table(spark, folder, "conversations").schema
    names = {"conversations": spark.readStream.schema(schema).parquet(path)}
    turns = spark.sql(A.spelt(A.TURNS, A.SPARK), **names)
    to = scratch_path(spark, "stream")
    jobs.keep_batches(working.last_items(turns), f"{to}/out", f"{to}/checkpoint").awaitTermination()
    kept = spark.read.schema(T._parse_datatype_string(working.OUT + ", batch int")).parquet(f"{to}/out")
    latest = kept.groupBy("tenant", "session_id").agg(F.max("batch").alias("batch"))
    return kept.join(latest, ["tenant", "session_id", "batch"], "left_semi").select("tenant", "session_id", "id", "role", "position")

