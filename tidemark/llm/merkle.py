"""A Merkle manifest of a table, with a proof for every row.

Leaves of a group (a language) in order are appended one by one to open subtrees. When a sibling of an open subtree is
complete, both become one, and the witness of each leaf in them gets one entry: what the other subtree's root is, and
on which side it stands. So each leaf's witness grows with the appends that concern it, and no tree is ever walked.

A task appends one block: SIZE leaves that begin at a multiple of SIZE, so a block's tree is a whole subtree of the
group's tree. The roots of a group's blocks are appended in the same way, block by block, until one root remains; then
the groups' roots are. A leaf's proof is its witness in its block, then its block's witness, and so on. Positions in a
group come from counts of a range-partitioned sort, so a group with most rows is dealt over many tasks like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import few, per_batch, written

#: Leaves of a block; a power of two.
LEVELS = 12
SIZE = 1 << LEVELS


def hashed(*parts: bytes) -> bytes:
    """The SHA-256 of the parts one after the other, as hexadecimal text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Block:
    """Appended leaves, their open subtrees from the largest on, and the witness of each leaf so far.

    A witness has two strings: a letter a level (L or R: where the sibling stands; -: there is none) and the siblings'
    digests, 32 bytes each.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int, int]] = []  # height, root, first leaf, leaf after the last
        self.sides: list[bytearray] = []
        self.siblings: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        at = len(self.sides)
        self.sides.append(bytearray()), self.siblings.append(bytearray())
        self.open.append((0, leaf, at, at + 1))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        """The last two open subtrees, of one height, become one."""
        height, right, middle, end = self.open.pop()
        _, left, start, _ = self.open.pop()
        self._extend(start, middle, b"R", right)
        self._extend(middle, end, b"L", left)
        self.open.append((height + 1, hashed(left, right), start, end))

    def _extend(self, start: int, end: int, side: bytes, sibling: bytes) -> None:
        raw = bytes.fromhex(sibling.decode())
        for k in range(start, end):
            self.sides[k] += side
            self.siblings[k] += raw

    def close(self, height: int | None) -> bytes:
        """The root. With a height, that of the subtree of this height; else of the smallest tree of all leaves."""
        while True:
            own, root, start, end = self.open[-1]
            if len(self.open) == 1 and (own == height or height is None):
                return root
            if len(self.open) > 1 and own == self.open[-2][0]:
                self._join()
                continue
            self.open[-1] = (own + 1, hashed(root), start, end)  # the last run has one node only
            for k in range(start, end):
                self.sides[k] += b"-"


def folded(leaf: bytes, sides: str, siblings: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = 0
    for side in sides:
        if side == "-":
            leaf = hashed(leaf)
            continue
        other = siblings[at : at + 32].hex().encode()
        leaf = hashed(other, leaf) if side == "L" else hashed(leaf, other)
        at += 32
    return leaf


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in UTF-8 bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _appended(rows: DataFrame, group: str, alone: bool) -> DataFrame:
    """rows (group, position from 0, node, last: whether the group has one block only) with sides, siblings and block,
    and a row (group, position: the block's, node: its root, block null) for each block.

    alone: blocks that are whole groups get their smallest tree; else all have LEVELS levels.
    """
    columns = [group, "position", "node", "sides", "siblings", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, single = None, [], Block(), False
        out: list[tuple] = []

        def close() -> None:
            root = block.close(None if single and alone else LEVELS)
            own, number = key
            out.extend((own, p, n, s.decode(), bytes(w), number) for (p, n), s, w in zip(held, block.sides, block.siblings, strict=True))
            out.append((own, number, root.decode(), None, None, None))

        def batch() -> pa.RecordBatch:
            kinds = (own_type, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64())
            made = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], columns)
            out.clear()
            return made

        own_type = pa.string()
        for part in batches:
            own_type = part.column(0).type
            for own, position, node, last in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (own, position >> LEVELS) != key:
                    if key is not None:
                        close()
                        if len(out) >= SIZE:
                            yield batch()
                    key, held, block, single = (own, position >> LEVELS), [], Block(), last
                held.append((position, node))
                block.append(node.encode())
        if key is not None:
            close()
        if out:
            yield batch()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(group, "position", "node", "last").repartition(parts, F.col(group), F.shiftright("position", LEVELS)).sortWithinPartitions(group, "position")
    kind = rows.schema[group].dataType.simpleString()
    return dealt.mapInArrow(run, f"`{group}` {kind}, position long, node string, sides string, siblings binary, block long")


def _witnessed(nodes: DataFrame, group: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(leaves, roots) of nodes (group, position from 0, node).

    leaves: nodes with sides and siblings up to their group's root; roots: group, node. Each round appends blocks of
    SIZE nodes, so the rounds are as many as the logarithm of the largest group to the base SIZE, and each works on the
    roots of the one before.
    """
    rounds = []
    while True:
        held = few(nodes.groupBy(F.col(group).alias("_of")).agg(F.max("position").alias("_most")), label)
        most = held.agg(F.max("_most")).first()[0]
        held, same = held.select("_of", (F.col("_most") < SIZE).alias("last")), F.col(group).eqNullSafe(F.col("_of"))
        made = written(_appended(nodes.join(held, same).select(group, "position", "node", "last"), group, True), label)
        rounds.append(made.where("block is not null"))
        nodes = made.where("block is null").select(group, "position", "node")
        if most is None or most < SIZE:
            break
    above = rounds.pop()
    for below in reversed(rounds):
        up = above.select(F.col(group).alias("_of"), F.col("position").alias("_block"), F.col("sides").alias("_sides"), F.col("siblings").alias("_siblings"))
        found = below.join(up, F.col(group).eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_block")))
        above = found.select(group, "position", "node", F.concat("sides", "_sides").alias("sides"), F.concat("siblings", "_siblings").alias("siblings"))
    return above.select(group, "position", "node", "sides", "siblings"), nodes.select(group, "node")


def fold(rows: DataFrame, leaf: str = "leaf", into: str = "folded_root") -> DataFrame:
    """rows (leaf, sides, siblings, ...) with the root that leaf and proof lead to; null where one of them is."""
    columns = [leaf, "sides", "siblings"]
    others = [c for c in rows.columns if c != into]
    at = [others.index(c) for c in columns]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [None if None in x else folded(x[0].encode(), x[1], x[2]).decode() for x in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
        return pa.record_batch([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, into])

    kept = rows.select(*others)
    return kept.mapInArrow(per_batch(make), kept.withColumn(into, F.lit("")).schema)


def manifest(leaves: DataFrame, group: str = "lang") -> DataFrame:
    """leaves with subroot, root and the proof of each: sides (a letter a level, from the leaf on) and siblings.

    leaves: doc_id, leaf (hexadecimal text) and a group column, and more, which go through. In each group leaves
    ascend by doc_id (null first), then by leaf; equal ones in the order of the scan, which the results don't show. In
    each level every two consecutive nodes become the hash of both, a last single one the hash of itself, until one
    remains: the group's subroot. Subroots by group (null first, bytewise) give the root likewise.

    Rows with null or repeated ids, and equal rows, are leaves of their own. An empty table gives an empty result.
    Of texts nothing is read here, however long they are. Columns named like the added ones must not be there.
    """
    placed = numbered(leaves, ["doc_id", "leaf"], [group], "position", "merkle-leaves").withColumn("position", F.col("position") - 1)
    placed = written(placed.withColumn("node", F.col("leaf")), "merkle-placed")
    own, subroots = _witnessed(placed.select(group, "position", "node"), group, "merkle-blocks")
    ranked = numbered(subroots.select(F.col(group).alias("own"), "node"), ["own"], (), "position", "merkle-groups").withColumn("position", F.col("position") - 1)
    tops, root = _witnessed(ranked.select(F.lit(0).alias("whole"), "position", "node", "own"), "whole", "merkle-top")
    whole = root.first()  # one row, or none
    over = ranked.join(tops.drop("node"), "position").select(F.col("own").alias("_own"), F.col("node").alias("subroot"), F.col("sides").alias("_sides"), F.col("siblings").alias("_siblings"))
    over = few(over.withColumn("root", F.lit(whole["node"] if whole else None).cast("string")), "merkle-over")
    proofs = own.select(F.col(group).alias("_group"), F.col("position").alias("_position"), "sides", "siblings")
    found = placed.drop("node").join(proofs, F.col(group).eqNullSafe(F.col("_group")) & (F.col("position") == F.col("_position"))).drop("_group", "_position")
    found = found.join(over, F.col(group).eqNullSafe(F.col("_own")))
    proof = {"sides": F.concat("sides", "_sides"), "siblings": F.concat("siblings", "_siblings")}
    return found.withColumns(proof).drop("_own", "_sides", "_siblings", "position")


def verified(docs: DataFrame, group: str = "lang") -> DataFrame:
    """The manifest of documents, and what its proofs say about rows that were tampered with.

    A leaf is the hash of doc_id, source, lang, n_chars and text. Rows whose decimal doc_id has an unsigned crc32 that
    7 divides are tampered with (null ids: never): n_chars is one more there, nulls stay. Returns doc_id, leaf, subroot,
    root, proof_sha256 (of the proof's digests as hexadecimal text), folded_root and verified, sides and siblings. Nulls
    in any column have leaves, too; other columns of docs aren't read.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    before, after = F.concat(*map(field, map(F.col, names[:3]))), field(F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaf = F.sha2(F.concat(before, field(F.col("n_chars")), after), 256)
    other = F.when(tampered & F.col("n_chars").isNotNull(), F.sha2(F.concat(before, field(F.col("n_chars") + 1), after), 256)).otherwise(F.col("leaf"))
    leaves = docs.select(*names).withColumn("leaf", leaf).select("doc_id", group, "leaf", other.alias("now"))
    found = fold(manifest(leaves, group), "now")
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "sides", "siblings",
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _climb(name: str, base: str, group: str) -> str:
    """Rows of base (id, grp, pos, node, now, proof), each climbing level by level until its group has one node."""
    return f"""{name} AS (
  SELECT id, {group} AS grp, pos, node, now, proof, max(pos) OVER (PARTITION BY {group}) AS most FROM {base}
  UNION ALL
  SELECT id, grp, pos // 2, CASE WHEN r IS NULL THEN sha256(l) ELSE sha256(l || r) END,
    CASE WHEN r IS NULL THEN sha256(now) WHEN pos % 2 = 0 THEN sha256(now || r) ELSE sha256(l || now) END,
    proof || CASE WHEN r IS NULL THEN '' WHEN pos % 2 = 0 THEN r ELSE l END, most // 2
  FROM (SELECT *, max(CASE WHEN pos % 2 = 0 THEN node END) OVER w AS l, max(CASE WHEN pos % 2 = 1 THEN node END) OVER w AS r
    FROM {name} WHERE most > 0 WINDOW w AS (PARTITION BY grp, pos // 2))
)"""


def _crc_sql() -> str:
    """crc32 of ASCII digits: bit by bit, as DuckDB has no function for it."""
    return """list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k::INTEGER, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""


#: The same rows for DuckDB, as the query op11 has them.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, lang, sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
    CASE WHEN coalesce(xor({_crc_sql()}, 4294967295) % 7 = 0, false) THEN n_chars + 1 ELSE n_chars END AS n_chars, source, text FROM documents
), base AS (
  SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node,
    sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS now, '' AS proof FROM d
), {_climb("up", "base", "lang")}, sub AS (
  SELECT id, grp AS lang, node AS subroot, now, proof FROM up WHERE most = 0
), top AS (
  SELECT id, 0 AS whole, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, subroot AS node, now, proof FROM sub
), {_climb("over", "top", "whole")}
SELECT d.doc_id, d.leaf, s.subroot, o.node AS root, sha256(o.proof) AS proof_sha256, o.now AS folded_root, o.now = o.node AS verified
FROM d JOIN sub s ON s.id = d.id JOIN over o ON o.id = d.id AND o.most = 0
"""
