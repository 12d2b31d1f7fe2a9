"""N-gram Jaccard join: classes of documents whose shingle sets overlap by a given share, by joins over prefix trees.

1. Each text becomes its set of word shingles. Equal sets are one node (their least doc_id), so copies cost one row each.
2. A set is cut into m parts by hash. Two sets at the threshold differ in at most k shingles, so with m = k + 3 parts at
   least three parts are equal, whatever the texts are; sets meet in *buckets* of equal parts. Sizes are cut into
   classes, and m belongs to the class of the smaller set. This is exact: no link is lost.
3. Round one: in each bucket the members stand with the bucket's least node, in blocks of bounded size. A block's sets
   form a prefix tree in one order of the block's shingles (frequent first, so that near copies share long paths);
   all sets walk the tree together, a shared path's overlap is computed once, and a subtree is left when even all its
   remaining shingles could not reach the threshold.
4. Round two: buckets whose members are still in several classes are joined in full, but only sets outside the main class
   are walked against all members. So a group of k near copies costs about k, not k * k.

Texts are read twice (the second time only those of nodes that share a bucket) and never shuffled as long as the
candidate ids can be broadcast. No group is taken into one task: blocks are bounded by MOST_SHINGLES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm import text as T
from feedloom.llm.common import connected, small, stored, text_of

#: Shingles of the sets of one block, apart from single sets that have more.
MOST_SHINGLES = 1_000_000
#: Bytes of text whose words and shingles a worker holds at once, apart from a single longer text; about 100 bytes of memory go with each.
PIECE_BYTES = 512 << 10
#: Growth of the size classes, and equal parts asked for beyond one.
CLASS_GROWTH, SPARE = 1.5, 2
#: Cells of the table (shingles x walking sets) held at once.
MOST_CELLS = 24 << 20

PARTS_SCHEMA = "doc_id bigint, n bigint, set_a bigint, set_b bigint, parts array<bigint>"
SETS_SCHEMA = "node bigint, n bigint, shingles array<bigint>"


def size_classes(most: int) -> list[int]:
    """Least sizes of the classes, up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_GROWTH)))
    return out


def parts_needed(following: int, percent: int) -> int:
    """Parts for a class that ends before size ``following``: one more than two linked sets can differ in, and SPARE."""
    low = following - 1
    return (low + low * 100 // percent) * (100 - percent) // (100 + percent) + 1 + SPARE


def part_keys(values: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """Keys of the parts of one set, for its own class and for the class below if a linked smaller set can be in it.

    Empty parts give no key unless there are more than SPARE of them: of three equal parts one then has shingles.
    """
    n = len(values)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    schemes = [own] + [own - 1] * (own > 0 and -(-percent * n // 100) < bounds[own])
    keys = []
    spread = T.mix(values ^ T.U(0xA5A5A5A5A5A5A5A5))
    for c in schemes:
        m = parts_needed(bounds[c + 1], percent)
        part = (spread % T.U(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        there, first = np.unique(part[order], return_index=True)
        key = np.add.reduceat(spread[order], first)
        if m - len(there) > SPARE:
            every = np.zeros(m, dtype=np.uint64)
            every[there] = key
            there, key = np.arange(m), every
        keys.append(T.mix(key + T.mix(there.astype(np.uint64) + T.U(c * 1_000_003 + 7))))
    return np.concatenate(keys)


def sets_with_parts(percent: int, size: int):
    """Texts to set size, two fingerprints of the set, and part keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = size_classes(1 << 40)
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES):
                values, per = T.shingles(T.split_words(*T.raw(piece.column("text")), fold=True), size)
                n, a, b, keys = [], [], [], []
                for one in T.distinct_in(values, per):
                    n.append(len(one))
                    a.append(int(T.mix(one).sum(dtype=np.uint64).astype(np.int64)))
                    b.append(int(T.mix(one ^ T.U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    keys.append(part_keys(one, percent, bounds) if len(one) else one)
                at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
                flat = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "set_a", "set_b", "parts"],
                )

    return run


def sets_of_nodes(size: int):
    """Texts to whole shingle sets, for the second reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, most=PIECE_BYTES):
                values, per = T.shingles(T.split_words(*T.raw(piece.column("text")), fold=True), size)
                sets = list(T.distinct_in(values, per))
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                    names=["node", "n", "shingles"],
                )

    return run


class PrefixTree:
    """Sets in one global order of their shingles, kept as sorted rows with the length of the path shared with the row before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, index, count = np.unique(flat, return_inverse=True, return_counts=True)
        # A shingle of one set alone never adds to an overlap: it counts in the size but has no node in the tree.
        rank = np.empty(len(count), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        held = count[index] > 1
        item, owner = rank[index][held], owner[held]
        order = np.lexsort((item, owner))
        item = item[order]
        at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
        self.items = int((count > 1).sum())
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.paths = [item[a:b] for a, b in zip(at, at[1:])]
        self.rows = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes())
        self.shared = np.zeros(len(sets) + 1, dtype=np.int64)
        for k in range(1, len(self.rows)):
            x, y = self.paths[self.rows[k - 1]], self.paths[self.rows[k]]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            self.shared[k] = differ[0] if len(differ) else n

    def links(self, walking: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(set, those of ``walking`` that reach the threshold with it), for each set that has any; a set need not find itself."""
        step = max(1, MOST_CELLS // max(1, self.items))
        for at in range(0, len(walking), step):
            yield from self._walk(walking[at : at + step], percent)

    def _walk(self, walking: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        table = np.zeros((self.items, len(walking)), dtype=np.uint8)
        for column, i in enumerate(walking):
            table[self.paths[i], column] = 1
        size = self.size[walking]
        length = np.array([len(self.paths[i]) for i in self.rows], dtype=np.int64)
        sizes = self.size[self.rows]
        stack = [(0, len(self.rows), 0, np.arange(len(walking)), np.zeros(len(walking), dtype=np.int64))] if self.rows else []
        while stack:
            low, high, depth, active, overlap = stack.pop()
            to = int(self.shared[low + 1 : high].min()) if high - low > 1 else int(length[low])
            if to > depth:
                path = self.paths[self.rows[low]][depth:to]
                overlap = overlap + (table[path].sum(axis=0, dtype=np.int64)[active] if len(active) * 2 > table.shape[1] else table[np.ix_(path, active)].sum(axis=0, dtype=np.int64))
            if high - low == 1:
                i = self.rows[low]
                hit = 100 * overlap >= percent * (size[active] + self.size[i] - overlap)
                if hit.any():
                    yield i, walking[active[hit]]
                continue
            least, rest = int(sizes[low:high].min()), int((length[low:high] - to).max())
            best = overlap + np.minimum(rest, size[active] - overlap)
            may = (100 + percent) * best >= percent * (size[active] + least)
            if not may.any():
                continue
            active, overlap = active[may], overlap[may]
            cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low + 1 : high] == to)).tolist(), high]
            stack.extend((a, b, to, active, overlap) for a, b in zip(cuts, cuts[1:]))


def join_block(percent: int):
    """One block's sets to links (a, b) that hold its linked sets together: each set with the least node of its class here."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        lists = table.column("shingles").combine_chunks()
        at = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        sets = [flat[a:b] for a, b in zip(at, at[1:])]
        walks = np.flatnonzero(table.column("walks").to_numpy(zero_copy_only=False))
        comp = np.arange(len(sets))
        for i, linked in PrefixTree(sets).links(walks, percent):
            seen = np.unique(comp[np.append(linked, i)])
            if len(seen) > 1:
                comp[np.isin(comp, seen)] = seen[0]
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, node)
        root = least[comp]
        keep = root != node
        return pa.table({"a": pa.array(node[keep], pa.int64()), "b": pa.array(root[keep], pa.int64())})

    return run


def _chunk(total: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(float(MOST_SHINGLES)))).cast("int")


def _joined(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of all blocks; blocks: (large, block, part, node, walks)."""
    rows = blocks.join(sets.select("node", "shingles"), "node")
    return rows.groupBy("large", "block", "part").applyInArrow(join_block(percent), "a bigint, b bigint")


def jaccard_classes(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are runs outside blanks, A-Z lower-cased; a text's set is its distinct runs of ``size`` words, or its whole
    sequence where it has fewer. Rows link when 100 * common >= percent * union; component_id is the smallest doc_id
    reachable. Null or blank texts have an empty set and link with nothing; rows that share a doc_id are one document,
    linked by every text it stands on; rows without doc_id link with nothing and have a null component_id. An empty table gives no rows. Shingles are
    compared by 64-bit hashes.
    """
    rows = stored(text_of(docs).mapInArrow(T.tidy(sets_with_parts(percent, size)), PARTS_SCHEMA), "parts")
    filled = rows.where("n > 0 AND doc_id IS NOT NULL")
    nodes = stored(filled.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("node")), "nodes")

    heads = small(nodes.withColumnRenamed("node", "doc_id"))
    keyed = filled.join(heads, ["n", "set_a", "set_b", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n", F.explode("parts").alias("bucket"))
    shared = stored(keyed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("bucket", "least"), "buckets")
    members = stored(keyed.join(small(shared), "bucket").select("bucket", "least", "node", "n"), "members")
    rows_in = members.count()

    wanted = small(stored(members.select(F.col("node").alias("doc_id")).distinct(), "wanted", rows_in))
    sets = text_of(docs).join(wanted, "doc_id", "left_semi").mapInArrow(T.tidy(sets_of_nodes(size)), SETS_SCHEMA)
    # A doc_id on several texts is one document, so it joins the heads of all its sets.
    several = filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same = None
    if several.limit(1).count():
        sets = sets.dropDuplicates(["node", "shingles"])
        owners = filled.join(several, "doc_id").select("doc_id", "n", "set_a", "set_b").distinct()
        same = owners.join(nodes, ["n", "set_a", "set_b"]).where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # Round one: each member against the least node of its buckets, and against those of its block.
    stars = members.where("node <> least").select("least", "node", "n").distinct()
    stars = stored(stars, "stars", rows_in)
    spread = small(stored(stars.groupBy("least").agg(_chunk(F.sum("n")).alias("chunks")), "spread", rows_in), rows_in)
    placed = stars.join(spread, "least").select(F.col("least").alias("block"), F.expr("cast(pmod(xxhash64(node), chunks) as int)").alias("part"), "node")
    centres = spread.select(F.col("least").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), F.col("least").alias("node"))
    first = stored(_joined(placed.union(centres).withColumns({"walks": F.lit(True), "large": F.lit(False)}), sets, percent), "links-1")
    if same is not None:
        first = stored(first.union(same), "links-1")
    comps = connected(first)

    # Round two: buckets that still hold several classes. Classes that meet there make a region. A region is joined as a grid of
    # blocks, or bucket by bucket, whichever sends its sets to fewer blocks; either way all its linked pairs meet.
    labelled = members.join(small(comps, rows_in), "node", "left").select("bucket", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    still = stored(labelled.join(small(stored(mixed.select("bucket", "low"), "mixed", rows_in), rows_in), "bucket"), "open", rows_in)
    regions = connected(still.where("comp <> low").select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct())
    regions = small(regions.select(F.col("node").alias("comp"), F.col("comp").alias("region")), rows_in)
    inside = still.groupBy("node", "n", "comp").agg(F.count("*").alias("times")).join(regions, "comp")
    extent = stored(inside.groupBy("region").agg(F.sum("n").alias("extent"), (F.sum("times") / F.count("*")).alias("times")), "extents", rows_in)
    large = 2 * _chunk(F.col("extent")) > F.greatest(F.lit(2.0), F.col("times"))
    labelled = stored(
        still.join(regions, "comp")
        .join(small(extent, rows_in), "region")
        .select(large.alias("large"), F.when(large, F.col("bucket")).otherwise(F.col("region")).alias("block"), "node", "n", "comp")
        .distinct(),
        "open-blocks",
        rows_in,
    )
    per = labelled.groupBy("large", "block", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"))
    grid = (
        per.groupBy("large", "block")
        .agg(F.max(F.struct("k", "comp", "total")).alias("top"), F.sum("total").alias("total"), F.sum("mark").alias("mark"), F.sum("k").alias("k"))
        .select("large", "block", "mark", "k", F.col("top.comp").alias("main"), _chunk(F.col("total") - F.col("top.total")).alias("rows"), _chunk(F.col("total")).alias("cols"))
    )
    # Buckets with the same members need one join.
    grid = stored(grid.groupBy("mark", "k").agg(F.min(F.struct("large", "block", "main", "rows", "cols")).alias("g")).select("g.*"), "grid", rows_in)
    there = labelled.join(small(grid, rows_in), ["large", "block"]).withColumn("own", F.xxhash64("node"))
    walkers = there.where("comp <> main").select(
        "large",
        "block",
        F.explode(F.expr("transform(sequence(0, cols - 1), c -> cast(pmod(own, rows) as int) * cols + c)")).alias("part"),
        "node",
        F.lit(True).alias("walks"),
    )
    stands = there.select(
        "large",
        "block",
        F.explode(F.expr("transform(sequence(0, rows - 1), r -> r * cols + cast(pmod(own, cols) as int))")).alias("part"),
        "node",
        F.lit(False).alias("walks"),
    )
    blocks = walkers.union(stands).groupBy("large", "block", "part", "node").agg(F.max("walks").alias("walks"))
    second = stored(_joined(blocks, sets, percent), "links-2")
    comps = connected(first.union(second)) if second.limit(1).count() else comps

    classes = nodes.select("n", "set_a", "set_b", "node").join(comps, "node", "left").select("n", "set_a", "set_b", F.coalesce("comp", "node").alias("component"))
    out = rows.select("doc_id", "n", "set_a", "set_b").join(classes, ["n", "set_a", "set_b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 90, size: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their class's smallest, with all columns; one row where a doc_id is repeated.

    Rows without doc_id are kept, null and empty texts too (each is its own class). Among rows with the same doc_id the one with the
    least text that is not empty stays. Very long texts are compared whole; an empty table gives no rows.
    """
    classes = jaccard_classes(docs, percent, size)
    heads = stored(classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "heads")
    single, repeated = (heads.where(x).select("doc_id") for x in ("rows = 1", "rows > 1"))
    once = docs.join(small(single), "doc_id", "left_semi")
    again = (
        docs.join(small(repeated), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")) == "", F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))).alias("row"))
        .select("row.*")
    )
    return once.select(*docs.columns).union(again).union(docs.where(F.col("doc_id").isNull()))
