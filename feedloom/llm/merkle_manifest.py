"""Merkle manifest of a table: a tree of threes for each source, a tree over the sources, and a proof for every row.

Leaves get their place in their source from counts per range partition, so no source is ordered in one task. Blocks of
3 ** LEVELS consecutive leaves are aligned with the tree: a block's nodes are those of a subtree. A builder takes a block's
leaves in order and appends every node to the block's log when its last child is done, which is postorder. The blocks'
top nodes are the leaves of the next tier, until a source has one block left; the same is done over the sources.

A log needs no index. Before leaf i stand i leaves and, for each height, one node for every 3 ** height leaves, hence
leaf i has position ``i + i // 3 + i // 9 + ...``, and a node of height h the position of its last leaf plus h (subtrees
cut short at the end are completed by the very last leaf, so this holds for them too). Proofs read siblings there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stored

#: Children of a node, and the height of a block: 729 leaves, a log of at most 1,096 nodes.
RUN, LEVELS = 3, 6
BLOCK = RUN**LEVELS
DIGEST = 32
#: Bytes up to which proofs of blocks and counts are broadcast.
BROADCAST_BYTES = 32 << 20

LOG_SCHEMA = "tree string, block bigint, n bigint, nodes binary, ids array<bigint>, tampered binary"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers decimal."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered); tampered is null where the tampering changes nothing."""
    meta, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    changed = F.when(hit, leaf_of(*meta, F.replace(text, F.lit("\n"), F.lit(""))))
    return docs.select("doc_id", "source", leaf_of(*meta, text).alias("leaf"), changed.alias("tampered"))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with pos, the place from 0 in their ``tree`` by ``order`` (nulls first), and n, the tree's number of rows.

    Ranges of (tree, order) are sorted each by itself; places are the rows of earlier ranges plus the place inside. Rows equal in
    all of ``order`` are the same for the tree and take any order.
    """
    by = [tree, *order]
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    ranged = held.repartitionByRange(*by, "salt").sortWithinPartitions(*by, "salt").drop("salt")
    ranged = stored(ranged.withColumns({"part": F.spark_partition_id(), "row": inside}), "ranged")
    every = Window.partitionBy(tree)
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = ranged.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("held"))
    cells = cells.select(F.col(tree).alias("t"), F.col("part").alias("p"), (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("held").over(every).alias("n"))
    cells = stored(cells, "ranges")
    met = ranged.join(_hinted(cells, 64), F.col(tree).eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return met.select(*rows.columns, (F.col("base") + F.col("row")).alias("pos"), "n")


def _hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table with a broadcast hint if its rows of about ``row_bytes`` fit the bound, else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


# ---------------------------------------------------------------------------------------------- logs


def height(n: int) -> int:
    """Levels above the leaves of a block in a tree of ``n`` leaves: until one node is left, at most LEVELS."""
    up = 0
    while n > 1 and up < LEVELS:
        n, up = -(-n // RUN), up + 1
    return up


class Builder:
    """The append log of one block."""

    def __init__(self, levels: int) -> None:
        self.levels, self.log = levels, []
        self.open: list[list[str]] = [[] for _ in range(levels)]

    def append(self, node: str, level: int = 0) -> None:
        self.log.append(node)
        if level < self.levels:
            run = self.open[level]
            run.append(node)
            if len(run) == RUN:
                self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.append(digest("".join(run)), level + 1)

    def finish(self) -> str:
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return "".join(self.log)


def postorder(leaf: int, level: int = 0) -> int:
    """Position of the node of that level whose last leaf is ``leaf``."""
    at, rest = leaf + level, leaf // RUN
    while rest:
        at, rest = at + rest, rest // RUN
    return at


@lru_cache(maxsize=256)
def positions(count: int, levels: int) -> tuple[tuple[int, ...], ...]:
    """Postorder positions of all nodes of a block of ``count`` leaves, by level."""
    out = []
    for level in range(levels + 1):
        width = RUN**level
        out.append(tuple(postorder(min((j + 1) * width, count) - 1, level) for j in range(-(-count // width))))
    return tuple(out)


def _build(rows: DataFrame) -> DataFrame:
    """The logs of one tier, a row per (tree, block), from rows (tree, pos, n, leaf, id, tampered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, builder, ids, tampered = None, None, [], []

        def log() -> tuple:
            return (*key, bytes.fromhex(builder.finish()), ids, b"".join(tampered))

        for batch in batches:
            done = []
            for tree, block, n, leaf, i, other in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "leaf", "id", "tampered"))):
                if (tree, block, n) != key:
                    if builder:
                        done.append(log())
                    key, builder, ids, tampered = (tree, block, n), Builder(height(n)), [], []
                builder.append(leaf.hex())
                ids.append(i)
                tampered.append(other or leaf)
            if done:
                yield _logs(done)
        if builder:
            yield _logs([log()])

    blocks = rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint"))
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, LOG_SCHEMA)


def _logs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["tree", "block", "n", "nodes", "ids", "tampered"])


@dataclass
class Forest:
    """The logs of many trees, tier by tier from the leaves up; a tree ends in the tier where it has one block."""

    tiers: list[DataFrame]

    @staticmethod
    def of(rows: DataFrame) -> Forest:
        """From rows (tree, pos, n, leaf, id, tampered)."""
        tiers = [stored(_build(rows), "logs")]
        while (tiers[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
            above = tiers[-1].where(F.col("n") > BLOCK)
            up = F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n")
            nodes = above.select("tree", F.col("block").alias("pos"), up, _top().alias("leaf"), F.col("block").alias("id"), F.lit(None).cast("binary").alias("tampered"))
            tiers.append(stored(_build(nodes), "logs"))
        return Forest(tiers)

    def tops(self) -> DataFrame:
        """(tree, top) of every tree."""
        each = [t.where(F.col("n") <= BLOCK).select("tree", _top().alias("top")) for t in self.tiers]
        out = each[0]
        for more in each[1:]:
            out = out.union(more)
        return out


def _top() -> Column:
    """The node that a block's log ends with."""
    return F.substring("nodes", -DIGEST, DIGEST)


# -------------------------------------------------------------------------------------------- proofs
# A path is a byte string: for each level a byte 4 * (place in the run) + (number of siblings), then the siblings.


def local_path(nodes: str, leaf: int, places: tuple[tuple[int, ...], ...]) -> list[tuple[int, list[str]]]:
    """(place in the run, siblings) of a leaf, level by level inside its block; ``nodes`` is the log in hex."""
    out = []
    for row in places[:-1]:
        run = leaf - leaf % RUN
        others = [row[j] for j in range(run, min(run + RUN, len(row))) if j != leaf]
        out.append((leaf - run, [nodes[64 * p : 64 * p + 64] for p in others]))
        leaf //= RUN
    return out


def pack(path: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([4 * k + len(others)]) + bytes.fromhex("".join(others)) for k, others in path)


def unpack(path: bytes) -> list[tuple[int, list[str]]]:
    out, at = [], 0
    while at < len(path):
        k, count = divmod(path[at], 4)
        text = path[at + 1 : at + 1 + DIGEST * count].hex()
        out.append((k, [text[64 * j : 64 * j + 64] for j in range(count)]))
        at += 1 + DIGEST * count
    return out


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The top that follows from a node and the siblings on its way."""
    for k, others in path:
        node = digest("".join([*others[:k], node, *others[k:]]))
    return node


def proof_digest(path: list[tuple[int, list[str]]]) -> str:
    """H of all siblings on the way up."""
    return digest("".join(s for _, others in path for s in others))


def _children(tier: DataFrame) -> DataFrame:
    """(tree, id, path) for every leaf of a tier's blocks, from rows that carry the block's own way up as ``above``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, nodes, above = row["ids"], row["nodes"].hex(), row["above"] or b""
                places = positions(len(ids), height(row["n"]))
                paths = [pack(local_path(nodes, i, places)) + above for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(paths, pa.binary())], names=["tree", "id", "path"])

    return tier.select("tree", "n", "nodes", "ids", "above").mapInArrow(run, "tree string, id bigint, path binary")


def _led(tier: DataFrame, ways: DataFrame, tops: DataFrame) -> DataFrame:
    """A tier's blocks with ``above``: the way from the block's top to the root, by ``ways`` (tree, id, path) and, for whole trees, ``tops`` (tree, path)."""
    ways = ways.select(F.col("tree").alias("wt"), F.col("id").alias("wb"), F.col("path").alias("wp"))
    tops = tops.select(F.col("tree").alias("tt"), F.col("path").alias("tp"), "top")
    many = tier.join(_hinted(tops, 1024), F.col("tree").eqNullSafe(F.col("tt"))).join(
        _hinted(ways, 1024), F.col("tree").eqNullSafe(F.col("wt")) & (F.col("block") == F.col("wb")), "left"
    )
    return many.withColumn("above", F.coalesce("wp", "tp")).select(*tier.columns, "above", "top")


def _ways(forest: Forest, tops: DataFrame) -> DataFrame:
    """The lowest tier's blocks with ``above`` and ``top``; ``tops``: (tree, path of the whole tree, top)."""
    spark = forest.tiers[0].sparkSession
    ways = spark.createDataFrame([], "tree string, id bigint, path binary")
    for tier in reversed(forest.tiers[1:]):
        # Ways of a tier's leaves hold to the root; blocks that are whole trees take the path of their tree.
        ways = stored(_children(_led(tier, ways, tops)), "ways")
    return _led(forest.tiers[0], ways, tops)


@dataclass
class Manifest:
    """Logs of all sources' trees and of the tree over the sources, and the root."""

    sources: Forest
    top: Forest
    names: DataFrame
    root: str


def build(docs: DataFrame) -> Manifest | None:
    """The manifest of ``docs``; None for an empty table.

    Rows of a source are ordered by doc_id (null first), equal ones by their digest; exact copies are leaves each. A null source is a
    tree of its own, before all others. Further columns are left out; null and empty texts are fields like any other.
    """
    rows = placed(leaves(docs), "source", "doc_id", "leaf")
    sources = Forest.of(rows.select(F.col("source").alias("tree"), "pos", "n", "leaf", F.col("doc_id").alias("id"), "tampered"))
    tops = sources.tops().select(F.lit("").alias("all"), F.col("tree").alias("source"), F.col("top").alias("leaf"))
    names = stored(placed(tops, "all", "source"), "sources")
    top = Forest.of(names.select(F.col("all").alias("tree"), "pos", "n", "leaf", F.col("pos").alias("id"), F.lit(None).cast("binary").alias("tampered")))
    found = top.tops().first()
    return Manifest(sources, top, names, bytes(found["top"]).hex()) if found else None


def proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    folded_root is computed from the tampered leaf where the row is tampered with, else from its own, with the siblings of the
    untampered tree. A null doc_id counts as not tampered with. An empty table gives no rows. Very long texts are hashed whole,
    in the JVM, before anything is shuffled.
    """
    manifest = build(docs)
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest is None:
        return docs.sparkSession.createDataFrame([], schema)
    root = manifest.root
    whole = docs.sparkSession.createDataFrame([("", bytearray(), None)], "tree string, path binary, top binary")
    steps = stored(_children(_ways(manifest.top, whole)), "source-ways").select("id", "path")
    tops = stored(manifest.names.join(steps, F.col("pos") == F.col("id")).select(F.col("source").alias("tree"), "path", F.col("leaf").alias("top")), "source-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, nodes, other, top = row["ids"], row["nodes"].hex(), row["tampered"].hex(), row["top"].hex()
                places, above = positions(len(ids), height(row["n"])), unpack(row["above"] or b"")
                leaf_hex, proof, folded = [], [], []
                for i in range(len(ids)):
                    path = local_path(nodes, i, places) + above
                    leaf_hex.append(nodes[64 * places[0][i] : 64 * places[0][i] + 64])
                    proof.append(proof_digest(path))
                    folded.append(fold(other[64 * i : 64 * i + 64], path))
                n = len(ids)
                columns = [pa.array(ids, pa.int64()), *map(pa.array, (leaf_hex, [top] * n, [root] * n, proof, folded, [x == root for x in folded]))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _ways(manifest.sources, tops).mapInArrow(run, schema)


# ----------------------------------------------------------------------------------------------- SQL


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, base: str) -> str:
    """Recursive CTEs ``name``: (tree, level, idx, n, h), and ``name_run``: the same with the siblings before and after."""
    window = "PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN"
    return f"""{name} AS (
  {base}
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n
), {name}_run AS (
  SELECT tree, level, idx, n, h,
         coalesce(string_agg(h, '') OVER ({window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER ({window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1
)"""


def crc32_sql(text: str, table: str) -> str:
    """CRC-32 of an ASCII string in SQL; ``table`` holds the 256 remainders."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])), 4294967295)"


CRC_TABLE = """SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS x(k))"""

ORACLE = f"""WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source AS tree, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)", "t")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS tampered
  FROM documents, crc
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM doc
), {_tree("node", "SELECT tree, 0 AS level, idx, n, leaf AS h FROM placed")},
sub AS MATERIALIZED (
  SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1
), {_tree("over", "SELECT 0 AS tree, 0 AS level, idx, n, h FROM sub")},
walk AS (
  SELECT rid, tree, level, idx, '' AS proof, tampered AS folded FROM placed CROSS JOIN (SELECT 0 AS level)
  UNION ALL
  SELECT w.rid, w.tree, w.level + 1, w.idx // 3, w.proof || l || r, sha256(l || w.folded || r)
  FROM walk w JOIN node_run s ON s.tree IS NOT DISTINCT FROM w.tree AND s.level = w.level AND s.idx = w.idx
), inner_end AS MATERIALIZED (
  SELECT w.rid, s.idx, s.h AS subroot, w.proof, w.folded FROM walk w JOIN sub s ON s.tree IS NOT DISTINCT FROM w.tree
  WHERE NOT EXISTS (SELECT 1 FROM node_run q WHERE q.tree IS NOT DISTINCT FROM w.tree AND q.level = w.level)
), rise AS (
  SELECT rid, 0 AS level, idx, subroot, proof, folded FROM inner_end
  UNION ALL
  SELECT w.rid, w.level + 1, w.idx // 3, w.subroot, w.proof || l || r, sha256(l || w.folded || r) FROM rise w JOIN over_run s ON s.level = w.level AND s.idx = w.idx
), top AS (SELECT level, h FROM over WHERE n = 1)
SELECT d.doc_id, d.leaf, e.subroot, top.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = top.h AS verified
FROM rise e JOIN top ON e.level = top.level JOIN doc d ON d.rid = e.rid"""
