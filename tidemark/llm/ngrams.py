"""Exact joins of documents by the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

Shingles are put into one order, the rarest first. Two similar sets must share a shingle among the first few of each
(the prefix); if prefixes are longer by k - 1, they must share k. A longer prefix costs more look-ups and lets fewer
pairs through. So each document's prefix is as long as its estimated cost says, look-ups and comparisons together, and
a pair has to share as many shingles as the shorter-sighted of its two documents asks for. Only such pairs are compared.

* Documents with equal sets are one class from the beginning, however many there are.
* A large group of near copies would have as many pairs as the square of its size. So at first each document is
  compared with one hub of its candidates only (the document that has the shared shingle earliest), and what links
  becomes one component. Then all remaining pairs that the prefixes let through are compared, but for those inside
  a component. No link between components is lost, and none inside matters to them.
* A shingle shared by very many documents is dealt over cells of bounded size, and so are the partners of a hub.

Order: the FREQUENT most frequent shingles come last, by frequency, found by counting all shingles of all documents;
all others come first, by hash. Any order gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, few, joined, per_batch, written
from .simhash import components, shingle_set

#: Shingles with a known frequency, at most, and the least frequency that matters; of about 12 bytes each.
FREQUENT, LEAST = 1 << 21, 4
#: Shared shingles that a prefix may ask for, at most.
MATCHES = 4
#: Shingles that a task sorts, or a range of hashes holds, at a time.
CHUNK, RANGE = 1 << 20, 1 << 22
#: Documents of a cell; partners of a hub compared in one go.
CELL, PARTNERS = 4_096, 1_024


def least_overlap(a, b, percent: int):
    """How many shingles two sets of these sizes share at least if they are similar."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def least_any(size, percent: int):
    """How many shingles a set shares at least with any set similar to it."""
    return (percent * size + 99) // 100


def _overlap(a: Column, b: Column, percent: int) -> Column:
    return F.floor((percent * (a + b) + (99 + percent)) / F.lit(100 + percent)).cast("long")


# -- classes ----------------------------------------------------------------------------------------


def _marked(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(row_id, doc_id, text, node, size), written: node is a digest of the row's set of shingles."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes = [], []
        for text in batch.column(2):
            own = shingle_set(text.as_py(), width)
            nodes.append(xxhash.xxh3_128_digest(own.tobytes())), sizes.append(len(own))
        return pa.record_batch([*batch.columns, pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64())], [*batch.schema.names, "node", "size"])

    kept = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(kept.mapInArrow(per_batch(make, 2), "row_id long, doc_id long, text string, node binary, size long"), "ngram-rows")


# -- the order of shingles --------------------------------------------------------------------------


def _dealt(width: int, bits: int):
    """(range, keys): the shingles of a task's texts by the first `bits` bits of their hashes; of each the next 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(sets: list[np.ndarray]) -> pa.RecordBatch:
            every = np.sort(np.concatenate(sets)) >> np.uint64(32 - bits)
            where = (every >> np.uint64(32)).astype(np.int64)
            low = every.astype(np.uint32)
            turns = np.flatnonzero(np.diff(where)) + 1
            parts = [(where[lo], low[lo:hi].tobytes()) for lo, hi in zip([0, *turns], [*turns, len(low)], strict=True)]
            return pa.record_batch([pa.array([w for w, _ in parts], pa.int64()), pa.array([k for _, k in parts], pa.binary())], ["range", "keys"])

        sets, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                sets.append(own := shingle_set(text.as_py(), width))
                n += len(own)
                if n >= CHUNK:
                    yield some(sets)
                    sets, n = [], 0
        if n:
            yield some(sets)

    return run


def _counted(bits: int):
    """(key, n) of the keys that come up LEAST times or more, from rows (range, keys) sorted by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LEAST
            return pa.record_batch([pa.array(keys[often].astype(np.int64) + (at << 32)), pa.array(n[often].astype(np.int64))], ["key", "n"])

        at, held = None, []
        for batch in batches:
            for where, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if where != at:
                    if held:
                        yield count()
                    at, held = where, []
                held.append(np.frombuffer(keys.as_py(), np.uint32))
        if held:
            yield count()

    return run


def frequent(marked: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, keys, counts): the most frequent shingles of all rows, FREQUENT at most, by the first bits + 32 bits of
    their hashes in ascending order.

    Every shingle of every row is counted. Shingles go to counting tasks as four bytes each, in as many ranges of
    hashes as hold about RANGE shingles. The driver gets FREQUENT rows at most.
    """
    total = marked.agg(F.sum("size")).first()[0] or 0
    bits = min(24, max(6, int(total // RANGE).bit_length()))
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.where("size > 0").select("text").mapInArrow(_dealt(width, bits), "range long, keys binary")
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range")
    counts = written(dealt.mapInArrow(_counted(bits), "key long, n long"), "ngram-counts")
    step = F.floor(F.log2("n") * 8).cast("int")  # some hundreds of steps
    room, least = FREQUENT, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if row["n"] > room:
            break
        room, least = room - row["n"], row["step"]
    found = counts.where(step >= least).orderBy("key").toArrow() if least is not None else counts.limit(0).toArrow()
    dropped(counts)
    return bits, found.column(0).to_numpy(), found.column(1).to_numpy()


def in_order(own: np.ndarray, bits: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set's shingles in the common order."""
    if not len(keys):
        return own
    key = (own >> np.uint64(32 - bits)).astype(np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return own[np.lexsort((own, np.where(keys[at] == key, counts[at], 0)))]


# -- candidates -------------------------------------------------------------------------------------


def _prefixes(shared, width: int, percent: int):
    """(id, size, tokens): of each set the shingles of its longest prefix, in order."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, tokens = [], []
        for text in batch.column(1):
            own = shingle_set(text.as_py(), width)
            most = len(own) - least_any(len(own), percent) + MATCHES
            sizes.append(len(own)), tokens.append(in_order(own, *shared.value)[:most].astype(np.int64))
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens), pa.int64()))
        return pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), lists], ["id", "size", "tokens"])

    return per_batch(make, 1)


def _hits(prefixes: DataFrame, percent: int) -> DataFrame:
    """(id, size, matches, pos, alone, token, n): each document's prefix, as long as it pays, of shingles that n > 1
    documents have in their longest prefixes; alone says how many before it no other document has there.

    With prefixes for k matches, the documents met number at most (all look-ups) / k, and each costs a comparison of
    the size of the set. The k with the least look-ups and comparisons in all is taken.
    """
    every = prefixes.select("id", "size", F.posexplode("tokens").alias("pos", "token"))
    counts = written(every.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "ngram-shared")
    hits = written(joined(every, counts.withColumn("shared", F.col("n")), ["token"]).select("id", "size", "pos", "token", F.col("shared").alias("n")), "ngram-hits")
    first = F.col("size") - F.floor((percent * F.col("size") + 99) / F.lit(100)).cast("long")
    met = [F.sum(F.when(F.col("pos") < first + k, F.col("n") - 1).otherwise(0)).alias(f"met{k}") for k in range(1, MATCHES + 1)]
    by = hits.groupBy("id", "size").agg(*met)
    cost = [F.struct((F.col(f"met{k}") * (1 + F.col("size") / (8.0 * k))).alias("cost"), F.lit(k).alias("k")) for k in range(1, MATCHES + 1)]
    chosen = by.where("met1 > 0").select("id", F.array_min(F.array(*cost))["k"].alias("matches"))
    found = hits.join(chosen, "id").where(F.col("pos") < first + F.col("matches"))
    alone = F.col("pos") + 1 - F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    found = written(found.select("id", "size", "matches", "pos", alone.cast("int").alias("alone"), "token", "n"), "ngram-chosen")
    dropped(counts, hits)
    return found


def _asked(a: str, b: str, need: Column) -> Column:
    """How many shingles of their prefixes a pair has to share."""
    return F.least(F.col(f"{a}matches"), F.col(f"{b}matches"), need)


def _may(a: str, b: str, percent: int) -> Column:
    """Whether a shared shingle at these places counts for the pair: both are in the prefixes that the pair needs, and it may
    be similar at all.

    What stands before a shared shingle in either document is in the prefixes of both, if it is shared. So of those before
    it the pair shares no more than either has that aren't its alone, and behind it no more than is left of either. That
    drops the many copies of a large group whose own edits are too many, though they all share what is left of the original.
    """
    need = _overlap(F.col(f"{a}size"), F.col(f"{b}size"), percent)
    k = _asked(a, b, need)
    low, high = F.least(f"{a}size", f"{b}size"), F.greatest(f"{a}size", f"{b}size")
    before = F.least(*(F.col(f"{x}pos") - F.col(f"{x}alone") for x in (a, b)))
    left = F.least(*(F.col(f"{x}size") - F.col(f"{x}pos") for x in (a, b)))
    inside = (F.col(f"{a}pos") < F.col(f"{a}size") - need + k) & (F.col(f"{b}pos") < F.col(f"{b}size") - need + k)
    return (100 * low >= percent * high) & inside & (before + left >= need)


def _hub_pairs(hits: DataFrame, percent: int) -> DataFrame:
    """(hub, other): for each document at most one partner, the hub with which it shares the most shingles.

    The hub of a shingle is the document that has it earliest in its order.
    """
    hub = hits.groupBy("token").agg(F.min(F.struct("pos", "id", "size", "matches", "alone")).alias("h"), F.count("*").alias("n"))
    hub = written(hub.where("n > 1").select("token", *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("pos", "id", "size", "matches", "alone")), "n"), "ngram-hubs")
    both = joined(hits.drop("n"), hub, ["token"]).where((F.col("id") != F.col("h_id")) & _may("", "h_", percent))
    shared = both.groupBy("id", "h_id").agg(F.count("*").alias("shared"))
    return shared.groupBy("id").agg(F.max_by("h_id", F.struct("shared", -F.col("h_id"))).alias("hub")).select("hub", F.col("id").alias("other"))


def _open_pairs(hits: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(hub, other): all pairs that the prefixes let through and that aren't in one component of found (node, root).

    Documents with the same shared shingles at the same places (near copies, mostly) are one class: shingles are looked
    up and counted for pairs of classes, and only pairs of classes that share enough are resolved into documents. Members of
    a class that are in one component are resolved together, so that no pair inside a component is ever made.
    """
    told = F.array_sort(F.collect_list(F.struct("pos", "token")))
    alike = hits.groupBy("id", "size", "matches").agg(F.sha2(F.to_json(F.struct("size", "matches", told.alias("told"))), 256).alias("alike"))
    first = alike.groupBy("alike").agg(F.min("id").alias("class"), F.count("*").alias("n"))
    members = joined(alike.select("id", "alike"), first, ["alike"]).join(found.select(F.col("node").alias("id"), "root"), "id", "left")
    members = written(members.select("id", "class", F.coalesce("root", "id").alias("root")), "ngram-classes")
    groups = written(members.groupBy("class", "root").agg(F.count("*").alias("n")), "ngram-groups")
    spread = groups.groupBy(F.col("class").alias("id")).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    named = hits.drop("n").join(spread, "id")  # a class's hits are those of its first member
    sizes = named.groupBy("token").agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("most")).where("least != most")
    # a shingle with many classes: each is at home in one cell and visits the later ones
    cells = written(sizes.select("token", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), "n"), "ngram-cells")
    placed = joined(named, cells, ["token"]).withColumn("home", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    placed = written(placed, "ngram-placed")
    visits = placed.withColumn("cell", F.explode(F.sequence("home", F.col("cells") - 1)))
    names = ("id", "low", "high", "size", "matches", "pos", "alone", "home")
    left = placed.select("token", F.col("home").alias("cell"), *(F.col(c).alias(f"a_{c}") for c in names))
    right = visits.select("token", "cell", *(F.col(c).alias(f"b_{c}") for c in names))
    once = (F.col("a_home") != F.col("b_home")) | (F.col("a_id") <= F.col("b_id"))
    several = (F.least("a_low", "b_low") != F.greatest("a_high", "b_high"))
    both = left.join(right, ["token", "cell"]).where(once & several & _may("a_", "b_", percent))
    asked = _asked("a_", "b_", _overlap(F.col("a_size"), F.col("b_size"), percent))
    pairs = both.groupBy(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).agg(F.count("*").alias("shared"), F.min(asked).alias("asked"))
    pairs = written(pairs.where("shared >= asked").select("a", "b"), "ngram-class-pairs")
    dropped(cells, placed)
    rooted = pairs.join(groups.select(F.col("class").alias("a"), F.col("root").alias("a_root")), "a").join(groups.select(F.col("class").alias("b"), F.col("root").alias("b_root")), "b")
    rooted = rooted.where((F.col("a_root") != F.col("b_root")) & ((F.col("a") != F.col("b")) | (F.col("a_root") < F.col("b_root"))))
    hubs = members.select(F.col("class").alias("a"), F.col("root").alias("a_root"), F.col("id").alias("hub"))
    others = members.select(F.col("class").alias("b"), F.col("root").alias("b_root"), F.col("id").alias("other"))
    return rooted.join(hubs, ["a", "a_root"]).join(others, ["b", "b_root"]).select("hub", "other")


# -- comparison -------------------------------------------------------------------------------------


def _compared(width: int, percent: int):
    """Over rows (cell, other, text) sorted by cell, other null first: (u, v) of the similar ones; u is the cell's hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            u, v = [], []
            for hub, other, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = shingle_set(text.as_py(), width)
                if other is None:
                    own = found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(found) - both):
                    u.append(hub), v.append(other)
            if u:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _similar(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): the pairs (hub, other) whose sets of shingles are similar, written.

    A hub's text meets those of its partners, PARTNERS at a time. Only texts of pairs are shuffled, as long as pairs
    are few.
    """
    pairs = written(pairs, "ngram-pairs")
    blocks = few(pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("blocks")), "ngram-partners")
    several = blocks.where("blocks > 1")
    block = F.pmod(F.xxhash64("other"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = few(pairs.join(several, "hub", "left").select("hub", "other", block.alias("block")), "ngram-visits")
    ours = texts.join(blocks.withColumnRenamed("hub", "id"), "id").select("id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "text")
    ours = ours.select(F.struct(F.col("id").alias("hub"), "block").alias("cell"), F.col("id").alias("hub"), F.lit(None).cast("long").alias("other"), "text")
    theirs = placed.join(texts.withColumnRenamed("id", "other"), "other").select(F.struct("hub", "block").alias("cell"), "hub", "other", "text")
    both = ours.union(theirs).withColumn("cell", F.xxhash64("cell.hub", "cell.block"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "cell", "hub").sortWithinPartitions("cell", "hub", "other")
    found = written(both.mapInArrow(_compared(width, percent), "u long, v long"), "ngram-links")
    dropped(pairs, blocks, placed)
    return found


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two rows link if 100 * (shingles in both) >= percent * (shingles in either), shingles being the distinct runs of
    width words (A-Z lower-cased; words are what lies between 20 and 09-0D hex); a text of fewer words is one shingle,
    and one that is null or without words has none and links with nothing. component_id is the smallest id that links
    lead to, the row's own included; null if no row of the component has one. Shingles are compared by 64-bit hashes.

    Rows with null or repeated ids, and equal rows, each give their row. Other columns of docs, whatever their names,
    aren't read. A task holds the shingles of a few texts, whole ones, also very long ones. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    marked = _marked(docs, width, id_col, text_col)
    nodes = marked.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row_id").alias("id"), F.count("*").alias("n"))
    nodes = written(nodes, "ngram-nodes")
    order = spark.sparkContext.broadcast(frequent(marked, width))
    copies = few(marked.where("size > 0").select("row_id").join(nodes.select(F.col("id").alias("row_id")), "row_id", "left_anti"), "ngram-copies")
    one_each = marked.where("size > 0").join(copies, "row_id", "left_anti").select(F.col("row_id").alias("id"), "text")
    prefixes = written(one_each.mapInArrow(_prefixes(order, width, percent), "id long, size long, tokens array<long>"), "ngram-prefixes")
    hits = _hits(prefixes, percent)
    dropped(prefixes)
    texts = marked.select(F.col("row_id").alias("id"), "text")
    near = _similar(_hub_pairs(hits, percent), texts, width, percent)
    more = _similar(_open_pairs(hits, components(near, "ngram-stars"), percent), texts, width, percent)
    found = components(near.union(more), "ngram-stars")
    dropped(hits)
    rooted = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("node", "n", "first_id", F.coalesce("root", "id").alias("root"))
    rooted = written(rooted, "ngram-rooted")
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "ngram-least")
    named = written(joined(rooted, least, ["root"], "members").select("node", "n", "component_id"), "ngram-named")
    kept = marked.select("doc_id", "node", F.col("size").alias("n_shingles"))
    linked = joined(kept.where("n_shingles > 0"), named, ["node"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(kept.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
