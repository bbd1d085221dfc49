"""Evaluation: recall of reference facts, latency and quality figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FUNCTIONAL, MULTI, PREDICATE_KIN
from ..functions.text import long_tokens


def _kin(refs: DataFrame) -> DataFrame:
    """refs, a row for each predicate that may stand for theirs."""
    kin = F.create_map(*(x for k, v in PREDICATE_KIN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return refs.withColumn("_p", F.explode(F.coalesce(kin[F.col("predicate")], F.array("predicate"))))


def _sets(rows: DataFrame, tokens: str) -> DataFrame:
    """(_p, <tokens>): the distinct token sets that rows have by predicate, each a text of its tokens in order."""
    return rows.where(F.col(tokens) != "").select("_p", tokens).distinct()


def _alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(_p, _a, _b, score): pairs of token sets whose overlap is at least `least`.

    Sets meet on a shared token, not pair by pair: without one the overlap is 0. Tokens are ranked from rare to frequent. A
    pair that reaches `least` shares a token that is among the rarest of its smaller set, so only as many of that set's
    rarest tokens are looked up as can't all be missed; frequent words hardly ever are.
    """
    often = left.select(F.explode(F.split("_a", " ")).alias("_t")).union(right.select(F.explode(F.split("_b", " ")))).groupBy("_t").agg(F.count("*").alias("_often"))

    def told(rows: DataFrame, tokens: str) -> DataFrame:
        """A row for each token: its rank from the rarest in its set, the set's size, how many are looked up."""
        words = F.split(tokens, " ")
        each = rows.select("_p", tokens, F.size(words).alias("_n"), F.explode(words).alias("_t")).join(often, "_t")
        rank = F.row_number().over(Window.partitionBy("_p", tokens).orderBy("_often", "_t"))
        return each.select("_p", tokens, "_t", "_n", rank.alias("_rank"), (F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).alias("_sought"))

    a = told(left, "_a")
    b = told(right, "_b").select("_p", "_b", "_t", F.col("_n").alias("_m"), F.col("_rank").alias("_rank2"), F.col("_sought").alias("_sought2"))
    small = a.where("_rank <= _sought").join(b, ["_p", "_t"]).where("_n <= _m")
    large = a.join(b.where("_rank2 <= _sought2"), ["_p", "_t"]).where("_m < _n")
    near = small.select("_p", "_a", "_b").union(large.select("_p", "_a", "_b")).distinct()
    x, y = F.split("_a", " "), F.split("_b", " ")
    return near.withColumn("score", F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).where(F.col("score") >= least)


def fuzzy_matches(refs: DataFrame, facts: DataFrame, least: float = 0.4) -> DataFrame:
    """For each reference fact (ref_id, subject, predicate, object) the best fact (position, subject,
    predicate, object): a kindred predicate, the same subject (or one that says user) and the largest overlap
    of objects, at least `least`; equal overlaps: the first position. References without one have nulls.

    References and facts repeat their words, so token sets are compared once for each distinct pair of them. Of each
    reference set the best fact is kept for each subject and for all that say user; references look those up.
    """
    key = lambda c: F.array_join(F.array_sort(long_tokens(F.col(c))), " ")
    left = _kin(refs.where(F.col("predicate").isin(*FUNCTIONAL, *MULTI))).withColumns({"_a": key("object"), "_s": F.lower("subject")})
    right = facts.select("position", F.lower("subject").alias("_s"), F.col("predicate").alias("_p"), F.col("object").alias("f_object"), key("object").alias("_b"))
    best = F.max_by(F.struct("position", "f_object", "score"), F.struct("score", -F.col("position"))).alias("b")
    scored = right.join(_alike(_sets(left, "_a"), _sets(right, "_b"), least), ["_p", "_b"])
    by = scored.groupBy("_p", "_a", "_s").agg(best)
    users = by.where(F.col("_s").contains("user")).select("_p", "_a", "b.*").groupBy("_p", "_a").agg(best)
    own = left.select("ref_id", "_p", "_a", "_s")
    found = own.join(by, ["_p", "_a", "_s"]).select("ref_id", "b.*").union(own.join(users, ["_p", "_a"]).select("ref_id", "b.*"))
    found = found.groupBy("ref_id").agg(best)
    return refs.join(found, "ref_id", "left").select("ref_id", "predicate", F.col("b.position").alias("position"), F.col("b.f_object").alias("found"), F.col("b.score").alias("score"))


def recall(refs: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: references found, and all references (those outside the vocabulary count but aren't sought)."""
    return fuzzy_matches(refs, facts).agg(F.count("position").alias("found"), F.count("*").alias("total"))


def gold_matches(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """gold (gold_id, episode, subject, predicate, object) with hit: whether a fact of the same episode has a
    subject that holds the gold one, a kindred predicate and an object that holds, or is held by, the gold one."""
    right = facts.select("episode", F.lower("subject").alias("fs"), F.lower("predicate").alias("_p"), F.lower("object").alias("fo"))
    pairs = _kin(gold).join(right, ["episode", "_p"])
    hit = F.col("fs").contains(F.col("subject")) & (F.col("fo").contains(F.col("object")) | F.col("object").contains(F.col("fo")))
    hits = pairs.where(hit).select("gold_id").distinct().withColumn("hit", F.lit(True))
    return gold.select("gold_id", "episode", "subject", "predicate", "object").join(hits, "gold_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def extraction_metrics(expected: DataFrame, gold: DataFrame, raw: DataFrame) -> DataFrame:
    """One row of figures for raw extractions (episode, raw), against what was expected of them.

    expected: episode, silent (nothing should be found). gold: gold_id, episode, subject, predicate, object, trap (it
    must not be found). valid: output that is a JSON object, with a list of facts if any; recalled of gold; trapped of traps; silence of
    silent; extra: facts beyond the gold ones and one more, in episodes that have gold; odd: predicates outside the
    vocabulary. Facts count as they are in the output, also those that validation would drop.
    """
    kind = "array<struct<subject: string, predicate: string, object: string>>"
    told, empty = F.get_json_object("raw", "$.facts"), F.array().cast(kind)
    good = F.from_json("raw", "map<string, string>").isNotNull()
    listed = raw.select("episode", F.when(good & told.isNull(), empty).otherwise(F.from_json(told, kind)).alias("facts"))
    told = expected.join(listed, "episode", "left").withColumns({"ok": F.col("facts").isNotNull(), "n": F.coalesce(F.size("facts"), F.lit(0))})
    each = listed.select("episode", F.inline("facts"))
    wanted = gold.where("NOT trap").groupBy("episode").agg(F.count("*").alias("wanted"))
    told = told.join(wanted, "episode", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    by_episode = told.agg(
        F.count_if("ok").alias("valid"), F.count("*").alias("episodes"), F.count_if(F.col("silent") & F.col("ok") & (F.col("n") == 0)).alias("silence"), F.count_if("silent").alias("silent"),
        F.coalesce(F.sum(F.when(F.col("wanted") > 0, F.greatest(F.lit(0), F.col("n") - F.col("wanted") - 1))), F.lit(0)).alias("extra"),
    )
    hits = gold_matches(gold, each).join(gold.select("gold_id", "trap"), "gold_id")
    by_gold = hits.agg(
        F.count_if(F.col("hit") & ~F.col("trap")).alias("recalled"), F.count_if(~F.col("trap")).alias("gold"),
        F.count_if(F.col("hit") & F.col("trap")).alias("trapped"), F.count_if("trap").alias("traps"),
    )
    odd = each.agg(F.count_if(~F.coalesce(F.lower("predicate"), F.lit("")).isin(*FUNCTIONAL, *MULTI)).alias("odd"))
    one = F.lit(1).alias("_one")
    return by_episode.select("*", one).join(by_gold.select("*", one), "_one").join(odd.select("*", one), "_one").drop("_one")


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.avg(value).alias("mean"), F.max(value).alias("longest")
    )


def plausibility(scores: DataFrame) -> DataFrame:
    """(expected, self_ref, salience): how many expected high have self_ref of 0.5 or more, how many expected
    low stay under 0.6."""
    high, low = F.col("expected") == "high", F.col("expected") == "low"
    return scores.agg(
        F.count_if(high & (F.col("self_ref") >= 0.5)).alias("high_ok"), F.count_if(high).alias("high"),
        F.count_if(low & (F.col("salience") < 0.6)).alias("low_ok"), F.count_if(low).alias("low"),
    )
