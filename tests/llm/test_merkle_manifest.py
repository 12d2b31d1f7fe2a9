"""The manifest against a tree built in plain Python, and against its SQL."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from feedloom.llm import merkle_manifest as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, pos string, tree string, n string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    def leaf(r, text):
        return h("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    levels = {}

    def grow(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
        return out

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
        levels[s] = grow([x[2] for x in trees[s]])
    over = grow([levels[s][-1][0] for s in names])
    out = []
    for number, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(trees[s]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            folded = leaf(r, r[1].replace("\n", "")) if hit else own
            siblings = ""
            for tree, at in ((levels[s], k), (over, number)):
                for level in tree[:-1]:
                    run = at - at % 3
                    a, b = "".join(level[run:at]), "".join(level[at + 1 : run + 3])
                    siblings += a + b
                    folded = h(a + folded + b)
                    at //= 3
            out.append((r[0], own, levels[s][-1][0], over[-1][0], h(siblings), folded, folded == over[-1][0]))
    return sorted(out, key=str)


def awkward():
    rows = [(k, f"line {k}\nline two of {k}" if k % 3 else f"plain {k}", "en", "big", k) for k in range(800)]
    rows += [(1000 + k, f"t\n{k}", None, f"s{k:04}", None) for k in range(760)]  # more sources than a block has leaves
    rows += [(5, None, None, None, None), (None, "x\ny", "é", None, 3), (7, "", "en", "é", 0), (8, "\n", "en", "é", 1), (9, "long\n" * 40000, "en", "Z", 1)]
    rows += [(8, "\n", "en", "é", 1), (8, "\n", "en", "é", 1), (8, "other\n", "en", "é", 1), (None, None, None, "é", None)]
    return rows


@pytest.mark.parametrize("pick", [slice(None), slice(800, 803), slice(0, 1), slice(0, 28), slice(1560, None)])
def test_as_brute_force(spark, pick):
    rows = awkward()[pick]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = sorted(map(tuple, M.proofs(docs).collect()), key=str)
    assert got == brute(rows)
    if len(rows) > 700:
        documents = pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])})
        con = duckdb.connect()
        con.register("documents", documents)
        assert sorted(con.sql(M.ORACLE).fetchall(), key=str) == got
        assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_empty(spark):
    assert M.proofs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("count", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 728, 729])
def test_postorder_positions(count):
    """The closed form addresses what a builder has written."""
    levels = M.height(count)
    builder, nodes = M.Builder(levels), [h(str(k)) for k in range(count)]
    for node in nodes:
        builder.append(node)
    log = builder.finish()
    for row in M.positions(count, levels):
        assert [log[64 * p : 64 * p + 64] for p in row] == nodes
        nodes = [h("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    assert log[-64:] == [log[64 * p : 64 * p + 64] for p in M.positions(count, levels)[-1]][0]


def test_paths_pack():
    path = [(0, []), (1, [h("a")]), (2, [h("b"), h("c")])]
    assert M.unpack(M.pack(path)) == path
