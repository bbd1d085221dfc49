"""Domain tables made from the plain tables, as SQL that Spark and DuckDB both run.

{name} stands for a table; @ARRAY, @EPOCH_MS and @JSON_K are spelt differently in the two.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

#: Start of the made-up clock, and the present.
BASE_MS, NOW_MS = 1_700_000_000_000, 1_710_800_000_000
SPARK = {"@ARRAY": "array", "@EPOCH_MS(ts)": "unix_millis(CAST(ts AS TIMESTAMP))", "@JSON_K": "get_json_object(props, '$.k')"}
DUCKDB = {"@ARRAY": "list_value", "@EPOCH_MS(ts)": "epoch_us(ts) // 1000", "@JSON_K": "json_extract_string(props, '$.k')"}

_H = "CAST((conv_id * 7919 + turn * 104729 + {k} * 1299709) % 1000 AS DOUBLE) / 1000"
_OPEN = "(conv_id + turn) % 11 = 0"
_AT = f"{BASE_MS} + (conv_id % 100) * 103680000 + turn * 600000"

TURNS = f"""
SELECT CAST(conv_id * 1000 + turn AS STRING) AS id, concat('t', CAST(conv_id % 3 AS STRING)) AS tenant, {_AT} AS created_at,
  CAST(conv_id AS STRING) AS session_id, role, text AS content,
  CASE WHEN {_OPEN} THEN 0.5e0 ELSE {_H.format(k=1)} END AS salience,
  CASE WHEN NOT ({_OPEN}) THEN {_H.format(k=2)} END AS surprise, CASE WHEN NOT ({_OPEN}) THEN {_H.format(k=3)} END AS arousal,
  CASE WHEN NOT ({_OPEN}) THEN {_H.format(k=4)} END AS self_ref, CASE WHEN NOT ({_OPEN}) THEN {_H.format(k=5)} END AS recurrence,
  CASE WHEN turn % 4 = 3 THEN 0.05e0 WHEN turn % 4 = 2 THEN 0.4e0 ELSE 1e0 END AS decay_state,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN {_AT} + 86400000 END AS last_decayed_at,
  CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN {_AT} + 7200000 END AS consolidated_at,
  (conv_id + turn) % 37 = 0 AS extraction_failed, (conv_id + 2 * turn) % 29 = 0 AS archived,
  @ARRAY(concat('item ', CAST(conv_id % 20 AS STRING)), concat('Item ', CAST(turn AS STRING))) AS entity_refs
FROM {{conversations}}
"""
#: Turns, each with the number of a vector; all vectors take part, however many there are.
EPISODES = f"""
SELECT t.*, (CAST(session_id AS BIGINT) * 8 + CAST(id AS BIGINT) % 1000) % (SELECT count(*) FROM {{embeddings}}) AS vec_id FROM ({TURNS}) t
"""
LOG = f"""
SELECT concat('t', CAST(user_id % 3 AS STRING)) AS tenant, event_id AS seq, @EPOCH_MS(ts) AS ts,
  CASE WHEN event_id % 17 = 0 THEN 'retract' ELSE 'assert' END AS op,
  concat(CASE WHEN event_id % 2 = 0 THEN 'User_' ELSE 'user_' END, CAST(user_id AS STRING)) AS subject,
  CASE event_type WHEN 'click' THEN 'works_at' WHEN 'view' THEN 'lives_in' WHEN 'error' THEN 'dislikes' WHEN 'purchase' THEN 'owns' ELSE 'prefers' END AS predicate,
  concat(CASE WHEN event_id % 3 = 0 THEN 'ITEM ' ELSE 'item ' END, CAST(CAST(@JSON_K AS INT) % 12 AS STRING)) AS object,
  least(value / 500, 1e0) AS confidence, concat('e', CAST(event_id AS STRING)) AS source
FROM {{events}}
"""
#: A log of one-valued facts with so many different objects that earlier ones are current nowhere.
WIDE_LOG = """
SELECT concat('t', CAST(user_id % 3 AS STRING)) AS tenant, event_id AS seq, @EPOCH_MS(ts) AS ts, 'assert' AS op, concat('user_', CAST(user_id % 6 AS STRING)) AS subject,
  CASE WHEN event_id % 2 = 0 THEN 'works_at' ELSE 'lives_in' END AS predicate, concat('item ', CAST(event_id % 997 AS STRING)) AS object, 1e0 AS confidence,
  concat('e', CAST(event_id AS STRING)) AS source
FROM {events}
"""
ENTITIES = f"""
SELECT concat('t', CAST(s_suppkey % 3 AS STRING)) AS tenant, s_name AS canonical_name,
  @ARRAY(concat('Sup ', CAST(s_suppkey AS STRING)), concat('s', CAST(s_suppkey % 20 AS STRING))) AS aliases,
  CASE s_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'place' END AS entity_type,
  {BASE_MS} + s_suppkey AS first_seen, {BASE_MS} + 2 * s_suppkey AS last_seen, CAST(s_suppkey % 7 AS BIGINT) AS episode_count
FROM {{supplier}}
"""
NAMES = """
SELECT c_custkey AS name_id, concat('t', CAST(c_custkey % 3 AS STRING)) AS tenant,
  CASE c_custkey % 5 WHEN 0 THEN concat('SUP ', CAST(c_custkey % 200 AS STRING)) WHEN 1 THEN concat('S', CAST(c_custkey % 40 AS STRING))
    WHEN 2 THEN c_name WHEN 3 THEN ' ' ELSE concat(' supplier#', lpad(CAST(c_custkey % 120 AS STRING), 9, '0')) END AS name
FROM {customer}
"""
ITEMS = f"""
SELECT concat('t', CAST(p_partkey % 3 AS STRING)) AS tenant, concat('Item ', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)) AS canonical_name,
  @ARRAY(p_brand) AS aliases, CASE p_partkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'org' WHEN 2 THEN 'place' END AS entity_type,
  {BASE_MS} + p_partkey AS first_seen, {BASE_MS} + p_partkey AS last_seen, CAST(p_partkey % 5 AS BIGINT) AS episode_count
FROM {{part}}
"""
#: Every fourth item is no entity.
GRAPH_ENTITIES = ITEMS.rstrip() + " WHERE CAST(floor(p_partkey / 3) AS BIGINT) % 4 <> 3\n"
MENTIONS = """
SELECT concat('t', CAST(user_id % 3 AS STRING)) AS tenant, concat(CASE WHEN event_id % 2 = 0 THEN 'Client ' ELSE 'client ' END, CAST(user_id % 30 AS STRING)) AS name,
  CASE event_type WHEN 'click' THEN 'person' WHEN 'error' THEN 'org' END AS entity_type,
  @ARRAY(concat('c', CAST(event_id % 4 AS STRING)), concat('C', CAST(event_id % 5 AS STRING)), concat('CLIENT ', CAST(user_id % 30 AS STRING))) AS aliases,
  @EPOCH_MS(ts) AS ts, event_id AS seq
FROM {events}
"""
RAW_EXTRACTIONS = """
SELECT CAST(conv_id * 1000 + turn AS STRING) AS id, CASE (conv_id * 8 + turn) % 7
  WHEN 0 THEN 'not json'
  WHEN 1 THEN concat('{{"facts":[{{"subject":" s', CAST(conv_id AS STRING), ' ","predicate":"Works_At ","object":"o', CAST(turn AS STRING),
    '","confidence":0.5}},{{"subject":"","predicate":"owns","object":"x"}}],"entities":[{{"name":" n', CAST(turn AS STRING), ' ","entity_type":"Person ","aliases":["a"," ","b "]}}]}}')
  WHEN 2 THEN '{{"facts":[{{"subject":"s","predicate":"owns","object":"x","confidence":1.5}},{{"subject":"t","predicate":"own","object":"y"}}],"entities":[{{"entity_type":"org"}}]}}'
  WHEN 3 THEN '{{"entities":[{{"name":"n","entity_type":"alien","aliases":[]}}]}}'
  WHEN 4 THEN '{{"facts":[{{"predicate":"owns","object":"x"}},{{"subject":"u","predicate":"likes_best","object":"z","confidence":"0.25"}},{{"subject":"u","predicate":"owns","object":"z","confidence":"high"}}]}}'
  WHEN 5 THEN '{{"facts":[],"entities":[]}}'
  ELSE concat('{{"facts":[{{"subject":"s","predicate":"has_goal","object":"g', CAST(conv_id AS STRING), '","confidence":1}},{{"subject":"s","object":"q"}}],"entities":[{{"name":"m","aliases":["z"]}}]}}') END AS raw
FROM {conversations}
"""
RAW_SALIENCE = """
SELECT CAST(conv_id * 1000 + turn AS STRING) AS id, CASE (conv_id * 8 + turn) % 6
  WHEN 0 THEN 'not json'
  WHEN 1 THEN '{{"surprise":0.5,"arousal":0.2}}'
  WHEN 2 THEN '{{"surprise":1.5,"arousal":-1,"self_ref":0.25,"recurrence":0.5}}'
  WHEN 3 THEN '{{"surprise":"0.75","arousal":"x","self_ref":0.25,"recurrence":0.5}}'
  WHEN 4 THEN concat('{{"surprise":', CAST(CAST(turn AS DOUBLE) / 8 AS STRING), ',"arousal":0.5,"self_ref":0.125,"recurrence":1}}')
  ELSE concat('{{"surprise":"0.25","arousal":0.5,"self_ref":', CAST(CAST(conv_id % 8 AS DOUBLE) / 8 AS STRING), ',"recurrence":0}}') END AS raw
FROM {conversations}
"""
SKILLS = """
SELECT p_partkey AS position, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS name, concat(p_type, ' ', p_brand) AS desc_, p_partkey AS seq
FROM {part}
"""
USES = """
SELECT concat('skill_', CAST(l_suppkey AS STRING)) AS name, l_orderkey * 10 + l_linenumber AS seq, l_orderkey AS ts, l_quantity > 20 AS success
FROM {lineitem}
"""
REFERENCE_FACTS = """
SELECT c_custkey AS ref_id, concat('user_', CAST(c_custkey % 150 AS STRING)) AS subject,
  CASE c_custkey % 5 WHEN 0 THEN 'works_at' WHEN 1 THEN 'lives_in' WHEN 2 THEN 'has_goal' WHEN 3 THEN 'owns' ELSE 'loves' END AS predicate,
  concat('Machine ', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN ' big one' ELSE '' END) AS object
FROM {customer}
"""
FOUND_FACTS = """
SELECT s_suppkey AS position, CASE WHEN s_suppkey % 3 = 0 THEN 'the user' ELSE concat('User_', CAST(s_suppkey % 150 AS STRING)) END AS subject,
  CASE s_suppkey % 4 WHEN 0 THEN 'works_at' WHEN 1 THEN 'is_a' WHEN 2 THEN 'has_attribute' ELSE 'lives_in' END AS predicate,
  concat(CASE s_suppkey % 3 WHEN 0 THEN 'machinery' WHEN 1 THEN 'household machine' ELSE 'building one' END, ' ', CAST(s_suppkey AS STRING)) AS object
FROM {supplier}
"""
#: A log in which every seventh row comes in days after the time of which it speaks.
LATE_LOG = f"""
SELECT tenant, seq, CASE WHEN seq % 7 = 0 THEN ts - (seq % 5 + 1) * 86400000 ELSE ts END AS ts, op, subject, predicate, object, confidence, source FROM ({LOG}) l
"""
#: Mentions between the rows of the log of things that are called items at times.
ALIASES = """
SELECT concat('t', CAST(user_id % 3 AS STRING)) AS tenant, concat(CASE WHEN event_id % 2 = 0 THEN 'Thing ' ELSE 'thing ' END, CAST(event_id % 5 AS STRING)) AS name, 'product' AS entity_type,
  @ARRAY(concat('Item ', CAST(event_id % 12 AS STRING)), concat('user_', CAST(user_id % 9 AS STRING))) AS aliases, @EPOCH_MS(ts) AS ts, event_id AS seq
FROM {events} WHERE event_id % 23 = 0
"""
#: Turns that say a fact plainly, of users; others as they are.
PLAIN_TURNS = f"""
SELECT t.*, CASE WHEN role = 'user' THEN concat('I ', CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'works_at' WHEN 1 THEN 'lives_in' WHEN 2 THEN 'prefers' ELSE 'owns' END,
  CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN ' ITEM ' ELSE ' item ' END, CAST(CAST(id AS BIGINT) % 12 AS STRING), '.') ELSE content END AS said
FROM ({TURNS}) t
"""
#: Questions of every type, each with the number of a vector; some in a session, some that can't be asked.
QUESTIONS = """
SELECT c_custkey AS question, concat('t', CAST(c_custkey % 3 AS STRING)) AS tenant, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 60 AS STRING) END AS session_id,
  CASE WHEN c_custkey % 97 = 0 THEN '' ELSE CASE c_custkey % 7
    WHEN 0 THEN concat('Where are we with ', c_mktsegment) WHEN 1 THEN concat('how to use the blue ', lower(c_mktsegment), ' brand#', CAST(c_custkey % 30 AS STRING))
    WHEN 2 THEN concat('history of my jobs at ', c_mktsegment) WHEN 3 THEN concat('what happened yesterday at ', c_name) WHEN 4 THEN concat('did we talk about la le ', c_mktsegment)
    WHEN 5 THEN concat('who is item ', CAST(c_custkey % 20 AS STRING)) ELSE concat('le the vert ', CAST(c_custkey AS STRING)) END END AS q,
  CASE WHEN c_custkey % 5 = 0 THEN 0.5e0 END AS min_salience, c_custkey % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {customer}
"""


def spelt(sql: str, dialect: dict[str, str]) -> str:
    for token, word in dialect.items():
        sql = sql.replace(token, word)
    return sql


def adapted(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A domain table from the tables of a folder."""
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return spark.sql(spelt(sql, SPARK), **{name: read_table(spark, folder, name) for name in names})


def for_duckdb(sql: str) -> str:
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return spelt(sql, DUCKDB).format(**{name: name for name in names}).strip()
