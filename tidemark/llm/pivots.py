"""Exact top-k search by pivot elimination.

Every vector carries its distances to many pivots, computed once. For a query q and a candidate x, the largest
|d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), which bounds the inner product from above.
Candidates are evaluated in the order of that bound until it falls below the k-th best score found: then no
other candidate can be among the best. Where many queries visit a block, its candidates are bounded in runs of like
distances, and the runs that are left for some queries are multiplied with all of those at once.

Candidates lie in blocks of like size, each with candidates near one pivot or a few. A block is known by its
ranges of pivot distances and its longest vector, which bound the inner products in it. Each query knows a score
from the start that its k-th best can't be under, from the rows among which the pivots were chosen. It visits only
the blocks whose bound reaches that score, and evaluates only candidates that do. A block's best go to a ranking by
query. Exact search of n / 20 queries over n rows is quadratic where bounds tell little; blocks keep memory flat
and let the pairs spread over any number of tasks.

Vectors with a component whose integer needs more than 63 bits have no distances that a float could hold: they meet
all others as Python's own integers, block by block. Only such vectors pay for that.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_batch, written

#: Candidates of a block, about; queries bounded together; candidates evaluated at a time; parts of a block's size
#: in which candidates are dealt to blocks.
BLOCK, TOGETHER, STEP, PARTS = 65_536, 64, 512, 8
#: Candidates that are bounded as one run and multiplied at once; queries of a block up to which candidates are bounded one by one.
RUN, FEW_ASK = 1_024, 8
#: Queries that are multiplied with such a run at once.
MANY = 256
#: Bytes of a block's candidates as they are multiplied, at most: blocks of long vectors hold fewer than BLOCK.
BLOCK_BYTES = 64 << 20
#: Candidates of a block where integers need more than 63 bits.
WIDE_BLOCK = 1_024
#: Pairs of queries and blocks handed on at a time, about.
PAIRS = 100_000
PIVOTS, POOL = 32, 512
_LEAST = -(2**63)
NAMES = ["key", "block", "asking", "vec_id", "v", "far", "least"]
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, v, most, width): floor(scale * x) of each component as packed integers of width bytes each, and the
    largest of their sizes: width is 8, or more if an integer needs more than 63 bits (most is 0 then).

    Rows whose id or vector is null, or that hold a null or non-finite component, are left out.
    """
    whole = Fraction(scale)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, packed, most, widths = [], [], [], []
        for vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if vec_id is None or v is None or None in v:
                continue
            x = np.array(v, np.float64)
            if not np.isfinite(x).all():
                continue
            with np.errstate(over="ignore"):
                x = np.floor(scale * x)
            ids.append(vec_id)
            if (np.abs(x) < 2.0**62).all():
                packed.append(x.astype(np.int64).tobytes()), most.append(int(np.abs(x).max(initial=0))), widths.append(8)
                continue
            own = [math.floor(whole * Fraction(c)) for c in v]
            width = max(9, max(c.bit_length() for c in own) // 8 + 1)
            packed.append(b"".join(c.to_bytes(width, "little", signed=True) for c in own)), most.append(0), widths.append(width)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(most, pa.int64()), pa.array(widths, pa.int32())], ["vec_id", "v", "most", "width"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(per_batch(make), "vec_id long, v binary, most long, width int")


def _matrix(packed: list[bytes], dims: int, kind: type = np.int64) -> np.ndarray:
    """Rows of integers, zeros behind shorter ones."""
    out = np.zeros((len(packed), dims), kind)
    for k, raw in enumerate(packed):
        x = np.frombuffer(raw, kind)
        out[k, : len(x)] = x
    return out


def arithmetic(most: int, dims: int) -> type:
    """What inner products of components up to `most` need to be exact: floats, 64-bit integers, or Python's own."""
    bound = most * most * max(1, dims)
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def pool_of(vecs: DataFrame, dims: int, pool: int = POOL) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the `pool` rows with the least hash."""
    rows = vecs.orderBy(F.xxhash64("v"), "vec_id").limit(pool).select("vec_id", "v").collect()
    return np.array([r["vec_id"] for r in rows], np.int64), _matrix([bytes(r["v"]) for r in rows], dims)


def choose_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n rows of x far from each other: farthest first."""
    x = x.astype(np.float64)
    if not len(x):
        return x
    chosen, apart = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def slack(far: float, long: float, dims: int, kind: type) -> float:
    """How much the difference of two distances up to `far`, held as 32-bit floats, may be off; long: the largest
    square of a vector's length."""
    return far * 2.0**-21 + (0.0 if kind is np.float64 else (far + 2 * math.sqrt(long)) * math.sqrt(dims * 2.0**-46))


def floors(ids: np.ndarray, x: np.ndarray, pool_ids: np.ndarray, pool: np.ndarray, k: int, kind: type) -> np.ndarray:
    """For each row of x a score that its k-th best candidate can't be under, from the rows of the pool."""
    out = np.full(len(x), _LEAST, object if kind is object else np.int64)
    if len(pool) <= k:
        return out
    scores = x.astype(kind) @ pool.astype(kind).T
    for row in range(len(x)):
        own = scores[row][pool_ids != ids[row]]
        if len(own) >= k:
            out[row] = int(np.sort(own)[-k])
    return out


def made_ready(x: np.ndarray, far_x: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's candidates as they are multiplied, the squares of their lengths, and their distances pivot by pivot."""
    long = np.concatenate([(x[k : k + STEP].astype(np.float64) ** 2).sum(axis=1) for k in range(0, len(x), STEP)]) if len(x) else np.zeros(0)
    return x.astype(kind), long, np.ascontiguousarray(far_x.T.astype(np.float32))


def _best_together(q, far_q, long_q, ids, c, near_x, long_x, off, skip, k, least):
    """As best_of_block, for many queries: runs of candidates are bounded as wholes by their ranges of pivot distances, and
    those that are left for some of MANY queries are multiplied with them at once. A run whose bound is under a query's
    k-th best score so far is skipped for it."""
    order = np.lexsort((near_x.max(axis=0, initial=0), near_x.argmin(axis=0))) if len(near_x) else np.arange(len(c))
    runs = [order[lo : lo + RUN] for lo in range(0, len(order), RUN)]
    low, high = (np.array([f(near_x[:, r], axis=1) for r in runs]).reshape(len(runs), len(near_x)) for f in (np.min, np.max))
    most = np.array([long_x[r].max() for r in runs])
    small = float(long_q.max(initial=0)) * float(long_x.max(initial=0)) < 2.0**46  # every partial sum is an integer under 2 ** 24
    c, ids = (c[order].astype(np.float32) if small else c[order]), ids[order]
    for at in range(0, len(q), MANY):
        own, far, skipped = q[at : at + MANY].astype(c.dtype), far_q[at : at + MANY], np.asarray(skip[at : at + MANY])
        floor = np.array([float(x) for x in least[at : at + MANY]])
        apart = np.zeros((len(own), len(runs)))
        for p in range(len(near_x)):
            np.maximum(apart, np.maximum(low[:, p] - far[:, p, None], far[:, p, None] - high[:, p]), out=apart)
        sizes = long_q[at : at + MANY, None] + most
        bound = (sizes - np.maximum(apart - off, 0) ** 2) / 2 + 1e-12 * sizes + 1
        who, place, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for r in np.argsort(-bound.max(axis=0), kind="stable"):
            rows = np.flatnonzero(bound[:, r] >= floor - np.abs(floor) * 1e-12)
            if not len(rows):
                continue
            lo = r * RUN
            got = own[rows] @ c[lo : lo + RUN].T
            a, b = np.nonzero(got >= floor[rows, None])
            other = ids[lo + b] != skipped[rows[a]]
            a, b = a[other], b[other]
            if not len(a):
                continue
            who, place, score = np.concatenate([who, rows[a]]), np.concatenate([place, lo + b]), np.concatenate([score, got[a, b].astype(np.float64)])
            best = np.lexsort((ids[place], -score, who))
            best = best[np.arange(len(best)) - np.searchsorted(who[best], who[best]) < k]
            who, place, score = who[best], place[best], score[best]
            ends = np.searchsorted(who, np.arange(len(own)), side="right")
            full = np.flatnonzero(np.bincount(who, minlength=len(own)) == k)
            floor[full] = np.maximum(floor[full], score[ends[full] - 1])
        begins = np.searchsorted(who, np.arange(len(own) + 1))
        for row in range(len(own)):
            some = slice(begins[row], begins[row + 1])
            yield order[place[some]], score[some].astype(np.int64)


def best_of_block(query: np.ndarray, far_q: np.ndarray, ids: np.ndarray, x: np.ndarray, far_x: np.ndarray, skip: np.ndarray, k: int, kind: type, least: np.ndarray, held: tuple | None = None):
    """Yields (places in the block, scores) of each query's k best candidates of `least` or more, ties to the
    smaller id.

    query, x: integers; far: distances to the pivots; skip: the id that a query may not get; kind: see arithmetic; held:
    what made_ready gives for the block, so that it is worked out once for all its queries.
    """
    q, (c, long_x, near_x) = query.astype(kind), held or made_ready(x, far_x, kind)
    long_q = (query.astype(np.float64) ** 2).sum(axis=1)
    off = slack(float(max(far_q.max(initial=0), far_x.max(initial=0))), float(max(long_q.max(initial=0), long_x.max(initial=0))), query.shape[1], kind)
    if kind is np.float64 and len(q) > FEW_ASK:
        yield from _best_together(q, far_q, long_q, ids, c, near_x, long_x, off, skip, k, least)
        return
    for at in range(0, len(q), TOGETHER):
        some = slice(at, at + TOGETHER)
        apart = np.zeros((len(q[some]), len(x)), np.float32)
        for p in range(far_x.shape[1]):
            np.maximum(apart, np.abs(far_q[some, p].astype(np.float32)[:, None] - near_x[p]), out=apart)
        sizes = long_q[some, None] + long_x
        bound = (sizes - np.maximum(apart - off, 0).astype(np.float64) ** 2) / 2 + 1e-12 * sizes + 1
        for row in range(len(bound)):
            upper, floor = bound[row], least[at + row]
            left = np.flatnonzero((upper >= float(floor) - abs(float(floor)) * 1e-12) & (ids != skip[at + row]))
            places, scores = np.empty(0, np.int64), np.empty(0, object if kind is object else np.int64)
            while len(left):
                if len(left) > STEP:
                    cut = np.argpartition(-upper[left], STEP - 1)
                    now, left = left[cut[:STEP]], left[cut[STEP:]]
                else:
                    now, left = left, left[:0]
                got = c[now] @ q[at + row]
                places, scores = np.concatenate([places, now]), np.concatenate([scores, got if kind is object else got.astype(np.int64)])
                best = np.lexsort((ids[places], -scores))[:k] if kind is not object else np.array(sorted(range(len(places)), key=lambda j: (-scores[j], ids[places[j]]))[:k], np.int64)
                places, scores = places[best], scores[best]
                if len(scores) == k:
                    left = left[upper[left] >= float(scores[-1]) - abs(float(scores[-1])) * 1e-12]
            good = scores >= floor
            yield places[good], scores[good]


def _keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many shuffle partitions an integer that hashing sends there."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts))
    found = spark.range(60 * parts + 100).select("id", at.alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()
    key = {r["at"]: r["id"] for r in found}
    return [key.get(p, p) for p in range(parts)]


def _layout(counts: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each (cell, part), from the numbers of candidates in them: runs of like size."""
    total = counts.ravel().cumsum()
    middle = total - counts.ravel() / 2
    return np.minimum((middle * blocks / max(1, total[-1])).astype(np.int64), blocks - 1).reshape(counts.shape)


def _order(scores, digits: int) -> list[str]:
    """Texts in the order of the integers: the numbers, made positive, in so many hexadecimal digits and one."""
    return [format(int(s) + (1 << 4 * digits - 1), f"0{digits + 1}x") for s in scores]


def _long(score: int) -> int:
    return min(max(int(score), _LEAST), 2**63 - 1)


def _by_all(asking: DataFrame, candidates: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, vec_id, score, order): each query's k best of every block of candidates, by Python's integers."""
    spark = candidates.sparkSession
    blocks = max(1, math.ceil(candidates.count() / WIDE_BLOCK))
    homes = candidates.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asking"), "vec_id", "v", "width")
    visits = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asking"), "vec_id", "v", "width")

    def integers(raw: bytes, width: int) -> list[int]:
        return [int.from_bytes(raw[n : n + width], "little", signed=True) for n in range(0, len(raw), width)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for at, asks, vec_id, v, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != block:
                    block, held = at, []
                own = integers(v, width)
                if not asks:
                    held.append((vec_id, own))
                    continue
                scored = ((-sum(map(mul, own, x)), i) for i, x in held if i != vec_id)
                out += [(vec_id, i, -s) for s, i in heapq.nsmallest(k, scored)]
            scores = [s for *_, s in out]
            columns = [pa.array([q for q, _, _ in out], pa.int64()), pa.array([i for _, i, _ in out], pa.int64()), pa.array([_long(s) for s in scores], pa.int64())]
            yield pa.record_batch([*columns, pa.array(_order(scores, digits), pa.string())], ["query_id", "vec_id", "score", "order"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 10_000))
    dealt = homes.union(visits).repartition(parts, "block").sortWithinPartitions("block", "asking")
    return dealt.mapInArrow(search, "query_id long, vec_id long, score long, order string")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products (all, if fewer).

    is_query picks queries by the column vec_id; candidates are all other rows. Ties go to the smaller
    vec_id. Rows that repeat both id and vector count once; rows that share an id are all a query's own, and as
    queries they share one list of k, in which a candidate comes once for each of their vectors that it is best for.
    Shorter vectors count as if zeros followed; long ones make blocks of fewer candidates. Scores are ranked exactly
    at any size of the components; those beyond 64 bits are reported as the nearest number that has 64. Vectors that
    are null or hold null or non-finite components take no part. Extra columns aren't read; an empty table gives no rows.

    To the driver come POOL rows, the counts by which candidates are dealt to blocks, and two numbers for each
    block and pivot: a few kilobytes for BLOCK candidates.
    """
    spark = vectors.sparkSession
    every = written(quantised(vectors, id_col, vector_col, scale).distinct(), "vectors")
    raw, wide = every.where("width = 8"), every.where("width > 8")
    n, longest, most = raw.agg(F.count("*"), F.max(F.length("v")), F.max("most")).first()
    n_wide, width, long_wide = wide.agg(F.count("*"), F.max("width"), F.max(F.length("v") / F.col("width"))).first()
    dims, kind = (longest or 0) // 8, next(t for t in _KINDS if (most or 0) <= np.iinfo(t).max)
    exact = arithmetic(most or 0, dims)
    digits = max(40, (16 * (width or 8) + int(max(dims, long_wide or 0)).bit_length()) // 4 + 2)
    told = exact is object or n_wide > 0  # scores that need more than 64 bits may come up
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dims))))
    blocks = max(1, math.ceil(n / block), min(spark.sparkContext.defaultParallelism, math.ceil(n / 2048)))
    pool_ids, pool = pool_of(raw, dims)
    pivots = choose_pivots(pool)
    parts = max(1, math.ceil(PARTS * blocks / max(1, len(pivots))))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(1).to_pylist(), dims)
        far = distances(x.astype(np.float64), pivots)
        cell = far.argmin(axis=1) if len(pivots) else np.zeros(len(x), np.int64)
        narrow = [r.tobytes() for r in x.astype(kind)]
        return pa.record_batch([batch.column(0), pa.array(narrow, pa.binary()), pa.array([r.tobytes() for r in far.astype(np.float32)], pa.binary()), pa.array(cell.astype(np.int32))], ["vec_id", "v", "far", "cell"])

    vecs = written(raw.select("vec_id", "v").mapInArrow(per_batch(measured), "vec_id long, v binary, far binary, cell int"), "measured")
    vecs = vecs.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))
    counts = np.zeros((max(1, len(pivots)), parts), np.int64)
    for row in vecs.groupBy("cell", "part").agg(F.count("*").alias("n")).collect():
        counts[row["cell"], row["part"]] = row["n"]
    layout = _layout(counts, blocks)

    def far_of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), len(pivots))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((blocks, len(pivots) + 1), np.inf), np.full((blocks, len(pivots) + 1), -np.inf)
        for batch in batches:
            own = layout[batch.column(2).to_numpy(), batch.column(3).to_numpy()]
            long = (_matrix(batch.column(0).to_pylist(), dims, kind).astype(np.float64) ** 2).sum(axis=1)
            told = np.concatenate([far_of(batch.column(1)), long[:, None]], axis=1)
            np.minimum.at(low, own, told), np.maximum.at(high, own, told)
        b, p = np.nonzero(high >= low)
        yield pa.record_batch([pa.array(b.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(low[b, p]), pa.array(high[b, p])], ["block", "pivot", "low", "high"])

    low, high = np.full((blocks, len(pivots) + 1), np.inf), np.full((blocks, len(pivots) + 1), -np.inf)
    ranged = vecs.select("v", "far", "cell", "part").mapInArrow(ranges, "block int, pivot int, low double, high double")
    for row in ranged.groupBy("block", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[row["block"], row["pivot"]], high[row["block"], row["pivot"]] = row["low"], row["high"]
    keys = np.array(_keys(spark, blocks), np.int32)
    shared = spark.sparkContext.broadcast((layout, low, high, keys, pool_ids, pool, pivots))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Candidates, each with its block."""
        layout, _, _, keys, *_ = shared.value
        own = layout[batch.column(3).to_numpy(), batch.column(4).to_numpy()]
        none = pa.nulls(batch.num_rows, pa.string())
        return pa.record_batch([pa.array(keys[own]), pa.array(own.astype(np.int32)), pa.array(np.zeros(batch.num_rows, bool)), *batch.columns[:3], none], NAMES)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries, each with every block that may hold one of its best."""
        _, low, high, keys, pool_ids, pool, pivots = shared.value
        step = max(1, PAIRS // blocks)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                ids, q = part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), dims, kind)
                far, long = distances(q.astype(np.float64), pivots), (q.astype(np.float64) ** 2).sum(axis=1)
                least = floors(ids, q, pool_ids, pool, k, exact)
                reach = slack(float(max(far.max(initial=0), high[:, :-1].max(initial=0))), float(max(long.max(), high[:, -1].max())), dims, exact)
                who, where = [], []
                for row in range(len(q)):
                    apart = np.maximum(low[:, :-1] - far[row], far[row] - high[:, :-1]).max(axis=1, initial=0)
                    sizes = long[row] + high[:, -1]
                    bound = (sizes - np.maximum(apart - reach, 0) ** 2) / 2 + 1e-12 * sizes + 1
                    found = np.flatnonzero(bound >= float(least[row]) - abs(float(least[row])) * 1e-12)
                    who.append(np.full(len(found), row)), where.append(found)
                who, where = np.concatenate(who), np.concatenate(where)
                take, floor = pa.array(who), pa.array([str(x) for x in least], pa.string())
                columns = [pa.array(keys[where]), pa.array(where.astype(np.int32)), pa.array(np.ones(len(who), bool)), part.column(0).take(take), part.column(1).take(take)]
                yield pa.record_batch([*columns, pa.nulls(len(who), pa.binary()), floor.take(take)], NAMES)

    schema = "key int, block int, asking boolean, vec_id long, v binary, far binary, least string"
    rows = vecs.select("vec_id", "v", "far", "cell", "part")
    dealt = rows.mapInArrow(per_batch(deal), schema).union(rows.where(is_query).mapInArrow(visits, schema))
    dealt = dealt.repartition(blocks, "key").sortWithinPartitions("block", "asking")

    def answer(homes: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, far, held = homes
        asked, q = part.column(3).to_numpy(), _matrix(part.column(4).to_pylist(), dims, kind)
        least = np.array([int(t) for t in part.column(6).to_pylist()], object if exact is object else np.int64)
        best = best_of_block(q, distances(q.astype(np.float64), shared.value[-1]), ids, x, far, asked, k, exact, least, held)
        out = [(np.full(len(s), a), ids[p], s) for a, (p, s) in zip(asked, best, strict=True)]
        who, whom, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        order = pa.array(_order(scores, digits), pa.string()) if told else pa.nulls(len(who), pa.string())
        if exact is object:
            scores = np.array([_long(s) for s in scores], np.int64)
        return pa.record_batch([pa.array(who), pa.array(whom), pa.array(scores), order], ["query_id", "vec_id", "score", "order"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, homes = None, [], None
        for batch in batches:
            blocks_, asking_ = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((blocks_[1:] != blocks_[:-1]) | (asking_[1:] != asking_[:-1])) + 1
            for lo, hi in zip([0, *turns], [*turns, len(blocks_)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if blocks_[lo] != block:
                    block, parts, homes = blocks_[lo], [], None
                if not asking_[lo]:
                    parts.append((part.column(3).to_numpy(), _matrix(part.column(4).to_pylist(), dims, kind), far_of(part.column(5))))
                    continue
                if parts:
                    homes, parts = tuple(map(np.concatenate, zip(*parts, strict=True))), []
                    homes = (*homes, made_ready(homes[1], homes[2], exact))
                if homes is not None:
                    yield answer(homes, part)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long, order string")
    if n_wide:
        found = found.union(_by_all(wide.where(is_query), every, k, digits)).union(_by_all(raw.where(is_query), wide, k, digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("order"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows for DuckDB, as the query op7 has them.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
