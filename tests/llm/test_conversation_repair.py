"""Repair against exhaustive search, whole conversations against ones in pieces, and the query against its SQL."""

import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from feedloom.llm import conversation_repair as C

LEGAL = {"", *("s" * k + "ua" * n for k in (0, 1) for n in range(1, 12))}


def brute(signs):
    """The least (cost, audit) of all edit scripts with up to three inserts at a place."""
    options = []
    for sign in signs:
        own, more = sign.lower(), 5 * sign.isupper()
        each = [("D", "", 2)]
        if sign != "x":
            each += [("K", own, more)] if own != "o" else []
            each += [("R", r, 1 + more) for r in "ua" if r != own]
        options.append(each)
    fills = [("I" * k, "".join(p), 5 * k) for k in range(3) for p in itertools.product("ua", repeat=k)]
    best = None
    for choice in itertools.product(*itertools.chain.from_iterable([fills, o] for o in options), fills):
        if "".join(r for _, r, _ in choice) in LEGAL:
            found = sum(c for *_, c in choice), "".join(m for m, *_ in choice)
            best = found if best is None or found < best else best
    return best


@pytest.mark.parametrize("signs", ["", *itertools.chain.from_iterable(map("".join, itertools.product("suaoxSUAO", repeat=k)) for k in (1, 2))])
def test_short_ones_exhaustively(signs):
    assert C.search(signs)[:2] == brute(signs)


def test_longer_ones():
    rng = random.Random(2)
    for _ in range(12):
        signs = "".join(rng.choice("suaoxUA") for _ in range(3))
        assert C.search(signs)[:2] == brute(signs), signs


def test_matrices_and_bounds_agree():
    rng = random.Random(3)
    for _ in range(200):
        signs = "".join(rng.choice("suuaaaoxSUAO") for _ in range(rng.randrange(0, 30)))
        cost, audit, _ = C.search(signs)
        assert cost == min(C.matrix(signs)[0] + C.END) == C.bounds(signs, C.END)[0][0] if signs else cost == 0
        at = rng.randrange(len(signs) + 1)
        left, right = signs[:at], signs[at:]
        _, a, role = C.search(left, C.NONE, C.bounds(right, C.END)[0]) if right else (0, "", 0)
        assert not right or a + C.search(right, role)[1] == audit


CLASHING = "conv string, part string, seg string, marks string, signs string"


def rows():
    rng = random.Random(4)
    out = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30])):
            text = rng.choice(["Yes.", "Well then", "What?", " \n", "", f"turn {turn}! ", "tab\t.\n", "no end"])
            out.append((conv, turn + rng.choice([0, 0, 0, 3]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    out += [(99, t, "user" if t % 2 == 0 else "assistant", f"said {t % 40}.") for t in range(400)]  # a third of all
    out += [(None, None, None, None), (None, 1, "user", None), (100, None, "system", "S."), (100, None, "user", "U?"), (100, 3, None, "x."), (101, 0, "", "Empty role.")]
    out += [(102, 0, "user", "same."), (102, 0, "user", "same."), (102, 0, "user", "same."), (103, 1, "user", "long text " * 150000 + "."), (103, 2, "assistant", "A.")]
    return out


@pytest.mark.parametrize("most", [5, 4096])
def test_as_sql_and_in_pieces(spark, most):
    data = rows()
    table = spark.createDataFrame([(*r, *"abcde") for r in data], "conv_id bigint, turn bigint, role string, text string, " + CLASHING)
    got = sorted(map(tuple, C.repair(C.damage(table), most).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array([r[i] for r in data], t) for i, (n, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}))
    wanted = con.sql(C.ORACLE)
    assert wanted.columns == C.NAMES
    assert got == sorted(wanted.fetchall(), key=str)
    assert len(got) == len({r[0] for r in data})
    assert {c for r in got for c in r[7]} >= set("DKR")


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert C.damaged_and_repaired(none).collect() == []


def test_all_gone(spark):
    one = spark.createDataFrame([(1, 1, "user", "x", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    assert C.repair(one).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
