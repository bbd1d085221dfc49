"""Operators on episodes: reads, scoring state, decay, archiving and hybrid search.

State is kept as append-only logs (episodes, scores, outcomes); these functions derive views of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_MS, Settings
from ..functions.vectors import code_similarity, cosine, recency, sparse_code

ROLES = ("user", "assistant", "system")


def checked(q: str, k: int, min_salience: float | None = None) -> None:
    """Raises ValueError for a question or a number of results that a search doesn't take."""
    if not 1 <= len(q) <= 4_000:
        raise ValueError("a question has 1 to 4,000 characters")
    if not 1 <= k <= 100:
        raise ValueError("a search gives 1 to 100 results")
    if min_salience is not None and not 0 <= min_salience <= 1:
        raise ValueError("salience lies between 0 and 1")


def taken_in(rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Valid rows as episodes, with their code and vector in the same projection, ready to be appended as one.

    embed adds vector to rows with content; see providers.embedded. What quarantine rejects is left out. Scores are
    null until the episode is scored; it starts with salience 0.5 and wholly fresh.
    """
    good = quarantine(rows).where("reject IS NULL").drop("reject")
    none = F.lit(None)
    return embed(good).select(
        "tenant", "id", "created_at", "session_id", "role", "content", F.lit(0.5).alias("salience"), *(none.cast("double").alias(n) for n in ("surprise", "arousal", "self_ref", "recurrence")),
        F.lit(1.0).alias("decay_state"), none.cast("long").alias("last_decayed_at"), none.cast("long").alias("consolidated_at"), F.lit(False).alias("extraction_failed"),
        F.lit(False).alias("archived"), F.array().cast("array<string>").alias("entity_refs"), sparse_code(F.col("content"), F.col("created_at")).alias("code"), "vector",
    )


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two lists (each with position) side by side; where one has no counterpart its columns are null and paired is
    false."""
    marked = right.withColumn("_there", F.lit(True))
    both = left.withColumn("_here", F.lit(True)).join(marked, "position", "full")
    return both.withColumn("paired", F.col("_here").isNotNull() & F.col("_there").isNotNull()).drop("_here", "_there")


def quarantine(rows: DataFrame) -> DataFrame:
    """rows with reject: why a row may not become an episode, or null if it may."""
    length, session, tenant = F.length("content"), F.length("session_id"), F.length("tenant")
    reject = (
        F.when(F.col("content").isNull() | (length < 1), "content empty")
        .when(length > 32_000, "content too long")
        .when(F.col("role").isNull() | ~F.col("role").isin(*ROLES), "role unknown")
        .when(session > 256, "session too long")
        .when(F.col("tenant").isNull() | (tenant < 1) | (tenant > 128), "tenant length")
    )
    return rows.withColumn("reject", reject)


def with_scores(episodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Episodes with the latest scores of a log (id, surprise, arousal, self_ref, recurrence, salience, at)."""
    names = ("surprise", "arousal", "self_ref", "recurrence", "salience")
    latest = scores.groupBy("id").agg(F.max_by(F.struct(*names), "at").alias("_new"))
    joined = episodes.join(latest, "id", "left")
    return joined.withColumns({n: F.coalesce(F.col(f"_new.{n}"), F.col(n)) for n in names}).drop("_new")


def with_outcomes(episodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Episodes with consolidated_at, extraction_failed and entity_refs from a log (id, at, failed, refs)."""
    latest = outcomes.groupBy("id").agg(F.max_by(F.struct("at", "failed", "refs"), "at").alias("_new"))
    joined = episodes.join(latest, "id", "left")
    return joined.withColumns({
        "consolidated_at": F.coalesce(F.col("_new.at"), F.col("consolidated_at")),
        "extraction_failed": F.coalesce(F.col("_new.failed"), F.col("extraction_failed")),
        "entity_refs": F.coalesce(F.col("_new.refs"), F.col("entity_refs")),
    }).drop("_new")


def by_id(episodes: DataFrame, id_: str) -> DataFrame:
    return episodes.where(F.col("id") == id_).limit(1)


def matching(
    episodes: DataFrame, tenant: str | None = None, session_id: str | None = None, window: tuple[int, int] | None = None,
    min_salience: float | None = None, include_archived: bool = False,
) -> DataFrame:
    """Episodes of a tenant (and session), in a closed time window, of at least min_salience."""
    held: list[Column] = []
    if tenant is not None:
        held.append(F.col("tenant") == tenant)
    if not include_archived:
        held.append(~F.col("archived"))
    if min_salience is not None:
        held.append(F.col("salience") >= min_salience)
    if session_id is not None:
        held.append(F.col("session_id") == session_id)
    if window is not None:
        held.append(F.col("created_at").between(*window))
    for condition in held:
        episodes = episodes.where(condition)
    return episodes


def recent(episodes: DataFrame, n: int, tenant: str, session_id: str | None = None) -> DataFrame:
    """The last n episodes that aren't archived, oldest first."""
    found = matching(episodes, tenant, session_id)
    return found.orderBy(F.desc("created_at"), F.desc("id")).limit(n).orderBy("created_at", "id")


def recent_each(episodes: DataFrame, n: int) -> DataFrame:
    """The last n of every tenant, with position (1 is the oldest of them)."""
    w = Window.partitionBy("tenant").orderBy(F.desc("created_at"), F.desc("id"))
    last = episodes.where(~F.col("archived")).withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)
    return last.withColumn("position", F.row_number().over(Window.partitionBy("tenant").orderBy("created_at", "id"))).drop("back")


def unscored(episodes: DataFrame, limit: int = 50, tenant: str | None = None) -> DataFrame:
    found = episodes.where(F.col("surprise").isNull() & ~F.col("archived"))
    if tenant is not None:
        found = found.where(F.col("tenant") == tenant)
    return found.orderBy("created_at", "id").limit(limit)


def candidates(episodes: DataFrame, now_ms: int, settings: Settings, limit: int | None = None) -> DataFrame:
    """Episodes ready for consolidation, most salient first."""
    ready = F.col("consolidated_at").isNull() & ~F.col("archived") & (F.col("salience") > settings.consolidation_threshold)
    ready &= F.col("created_at") <= now_ms - settings.consolidation_delay_ms
    return episodes.where(ready).orderBy(F.desc("salience"), "created_at", "id").limit(limit or settings.batch_size)


def pending_counts(episodes: DataFrame, now_ms: int, settings: Settings) -> DataFrame:
    """By tenant: unscored, and scored episodes above the threshold that are ready or still wait."""
    open_ = ~F.col("archived")
    due = open_ & F.col("surprise").isNotNull() & F.col("consolidated_at").isNull() & (F.col("salience") > settings.consolidation_threshold)
    old = F.col("created_at") <= now_ms - settings.consolidation_delay_ms
    return episodes.groupBy("tenant").agg(
        F.count_if(open_ & F.col("surprise").isNull()).alias("unscored"), F.count_if(due & old).alias("ready"), F.count_if(due & ~old).alias("waiting")
    )


def decay(episodes: DataFrame, now_ms: int, settings: Settings) -> DataFrame:
    """One decay step of what isn't archived: less for salient episodes; stamps last_decayed_at."""
    days = (F.lit(now_ms) - F.coalesce("last_decayed_at", "created_at")) / F.lit(float(DAY_MS))
    less = F.col("decay_state") - F.lit(settings.decay_rate_per_day) * days * (F.lit(2.0) - F.col("salience"))
    live = ~F.col("archived")
    return episodes.withColumns({
        "decay_state": F.when(live, F.greatest(F.lit(0.0), less)).otherwise(F.col("decay_state")),
        "last_decayed_at": F.when(live, F.lit(now_ms).cast("long")).otherwise(F.col("last_decayed_at")),
    })


def dry_run(episodes: DataFrame, now_ms: int, settings: Settings) -> DataFrame:
    """One row: how many episodes a decay step would change, and how many each archive rule would archive."""
    ruled = archive(episodes, now_ms, settings)
    after = decay(episodes, now_ms, settings)
    counts = ruled.agg(F.count_if(F.col("archive_rule") == 1).alias("faded"), F.count_if(F.col("archive_rule") == 2).alias("expired"))
    touched = after.agg(F.count_if(~F.col("archived")).alias("decayed"))
    return touched.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


def archive(episodes: DataFrame, now_ms: int, settings: Settings) -> DataFrame:
    """episodes with archive_rule: 1 decayed after consolidation, 2 expired without, null neither; and
    archived set accordingly."""
    faded = (F.col("decay_state") < settings.forgotten_below) & F.col("consolidated_at").isNotNull()
    expired = (
        (F.col("created_at") < now_ms - settings.retention_days * DAY_MS)
        & (F.col("salience") < settings.consolidation_threshold)
        & F.col("consolidated_at").isNull()
    )
    rule = F.when(F.col("archived"), None).when(faded, 1).when(expired, 2)
    return episodes.withColumn("archive_rule", rule).withColumn("archived", F.col("archived") | F.col("archive_rule").isNotNull())


def survivors(rows: DataFrame, episodes: DataFrame, key: str = "id") -> DataFrame:
    """rows (vectors, codes ...) of episodes that aren't archived."""
    return rows.join(episodes.where("archived").select(F.col("id").alias(key)), key, "left_anti")


def scoring_context(episodes: DataFrame, turns: int = 5) -> DataFrame:
    """episodes with history: the contents of up to `turns` turns before, same tenant and session."""
    w = Window.partitionBy("tenant", "session_id").orderBy("created_at", "id").rowsBetween(-turns, -1)
    return episodes.withColumn("history", F.collect_list("content").over(w))


def _last(rows: Column, n: int) -> Column:
    return F.when(F.size(rows) > n, F.slice(rows, F.size(rows) - n + 1, n)).otherwise(rows)


#: Rows of a tenant that a replay sorts in one task, about.
REPLAYED = 250_000


def replay(episodes: DataFrame, now_ms: int, turns: int = 5, blocks: int | None = None) -> DataFrame:
    """An import: history over all earlier rows of a tenant by time, and decay counted from now on.

    A tenant's time is cut into blocks at quantiles (as many as the largest tenant needs, REPLAYED rows each), and each
    block starts with the last rows before it, so that a large tenant is dealt over many tasks.
    """
    if blocks is None:
        blocks = 2 + (episodes.groupBy("tenant").count().agg(F.max("count")).first()[0] or 0) // REPLAYED
    shares = F.array(*(F.lit(k / blocks) for k in range(1, blocks)))
    cuts = episodes.groupBy("tenant").agg(F.percentile_approx("created_at", shares, F.lit(10_000)).alias("_cuts"))  # a row a tenant
    placed = episodes.join(cuts, "tenant").withColumn("_block", F.size(F.filter("_cuts", lambda c: c < F.col("created_at")))).drop("_cuts")
    kept = F.struct("created_at", "id", "content")
    back = Window.partitionBy("tenant", "_block").orderBy(F.desc("created_at"), F.desc("id"))
    tails = placed.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= turns).select("tenant", "_block", kept.alias("_row"))
    before = Window.partitionBy("tenant").orderBy("_block").rowsBetween(-turns, -1)  # blocks that are there have a row each
    ends = tails.groupBy("tenant", "_block").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))  # turns rows a block
    known = ends.withColumn("_rows", _last(F.flatten(F.collect_list("_rows").over(before)), turns)).where(F.size("_rows") > 0)
    early = ends.join(known.select("tenant", "_block", F.col("_rows").alias("_early")), ["tenant", "_block"], "left").select("tenant", "_block", F.coalesce("_early", F.array().cast("array<struct<created_at: bigint, id: string, content: string>>")).alias("_early"))
    w = Window.partitionBy("tenant", "_block").orderBy("created_at", "id").rowsBetween(-turns, -1)
    inside = placed.withColumn("_near", F.collect_list("content").over(w)).join(early, ["tenant", "_block"])
    whole = F.concat(F.transform("_early", lambda r: r["content"]), F.col("_near"))
    return inside.withColumns({"history": _last(whole, turns), "last_decayed_at": F.lit(now_ms).cast("long")}).drop("_block", "_near", "_early")


def working_memory(turns: DataFrame, items: int = 5) -> DataFrame:
    """The last items of each session of a tenant, in order (position from 1)."""
    w = Window.partitionBy("tenant", "session_id").orderBy(F.desc("created_at"), F.desc("id"))
    last = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= items)
    n = F.count("*").over(Window.partitionBy("tenant", "session_id"))
    return last.withColumn("position", (n - F.col("back") + 1).cast("int")).drop("back")


def live_sessions(turns: DataFrame, most: int = 100, reads: DataFrame | None = None) -> DataFrame:
    """The sessions touched last, over all tenants: (tenant, session_id, touched_at).

    reads: (tenant, session_id, at) of looks at a session's items, which touch it, too, if it has turns by then.
    """
    touched = turns.groupBy("tenant", "session_id").agg(F.min("created_at").alias("_since"), F.max("created_at").alias("touched_at"))
    if reads is not None:
        seen = reads.join(touched, ["tenant", "session_id"]).where(F.col("at") >= F.col("_since")).groupBy("tenant", "session_id").agg(F.max("at").alias("_read"))
        touched = touched.join(seen, ["tenant", "session_id"], "left").withColumn("touched_at", F.greatest("touched_at", "_read"))
    return touched.select("tenant", "session_id", "touched_at").orderBy(F.desc("touched_at"), "tenant", "session_id").limit(most)


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k vectors most similar to the query by cosine, ties to the smaller id."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_col, cosine(F.col(vector_col), asked).alias("similarity")).where("similarity IS NOT NULL")
    return scored.orderBy(F.desc("similarity"), id_col).limit(k)


def search(
    episodes: DataFrame, vectors: DataFrame, codes: DataFrame | None, query: Sequence[float], question: str, now_ms: int, settings: Settings, k: int = 10, mode: str = "post", **filters
) -> DataFrame:
    """The k best episodes by similarity, hash-code similarity and recency.

    mode post filters the nearest candidates, as a vector index does, and may return fewer than k; mode pre
    looks for candidates among the episodes that pass. codes: (id, code) of the episodes, of which those without
    one are left out; or None, and the codes of the candidates alone are worked out here.
    """
    checked(question, k, filters.get("min_salience"))
    kept = matching(episodes, **filters)
    if mode == "pre":
        vectors = vectors.join(kept.select("id"), "id", "left_semi")
    found = F.broadcast(nearest(vectors, query, settings.knn_candidates))  # knn_candidates rows
    asked = sparse_code(F.lit(question), F.lit(now_ms))
    near = kept.join(found, "id")
    near = near.withColumn("code", sparse_code(F.col("content"), F.col("created_at"))) if codes is None else near.join(codes, "id")
    scored = near.withColumns({
        "dense": F.col("similarity"), "sparse": code_similarity(F.col("code"), asked), "recent": recency(F.col("created_at"), now_ms, settings.half_life_days),
    })
    score = settings.dense_weight * F.col("dense") + settings.sparse_weight * F.col("sparse") + settings.recency_weight * F.col("recent")
    return scored.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)


def shown(episodes: DataFrame) -> DataFrame:
    """The view of an episode: no salience before it is scored."""
    return episodes.withColumn("salience", F.when(F.col("surprise").isNotNull(), F.col("salience")))
