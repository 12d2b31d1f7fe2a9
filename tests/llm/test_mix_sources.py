import pytest
from pyspark.sql import functions as F

from feedloom.llm import mix_sources as M

SCHEMA = "doc_id bigint, text string, source string, _times int, extra string"


def targets_by_sharing(sizes):
    """The contract's words as a loop: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    got, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share, left = left, 0.0
        for s in list(open_):
            got[s] += share * weight[s] / total
            if got[s] >= 3 * sizes[s]:
                left += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                open_.discard(s)
    return got


def rows(sizes):
    k, out = 0, []
    for source, total in sizes.items():
        while total > 0:
            n = min(total, 1 + k % 7)
            out.append((k, " ".join(f"w{k}x{j}" for j in range(n)), source, 1, "e"))
            total -= n
            k += 1
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 500},
        {"a": 2000, "b": 5, "c": 5, None: 30},
        {"é": 100, "z": 100, "Z": 100, "a": 100},
        {"only": 50},
    ],
)
def test_targets_and_budgets(spark, sizes):
    docs = spark.createDataFrame(rows(sizes), SCHEMA)
    got = M.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("taken"), F.first("source_size").alias("s")).collect()
    want = targets_by_sharing(sizes)
    for r in got:
        assert r["s"] == sizes[r["source"]]
        assert r["t"] == pytest.approx(want[r["source"]])
        assert abs(r["taken"] - r["t"]) <= 7
    assert M.mix(docs).where("times < 0 OR times > 3").count() == 0
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == M.mix(docs).agg(F.sum("times")).first()[0]


def test_nulls_ties_repeats_and_empty(spark):
    data = [(1, None, "a", 1, ""), (2, "", None, 1, ""), (3, "x y", "a", 1, ""), (3, "x y", "a", 1, ""), (None, "z " * 400, None, 1, "")]
    docs = spark.createDataFrame(data, SCHEMA)
    out = M.mix(docs)
    assert out.count() == 5
    assert sorted(r["size"] for r in out.collect()) == [0, 0, 2, 2, 400]
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in M.mix(docs.repartition(3)).collect()}
    assert M.mix(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0
    M.mixed(docs).collect()


def test_better_documents_come_first(spark):
    data = [(k, ("clean words here " if k % 2 else "ba#*$% wo#*$% he#*$% ") * 5, "a" if k < 400 else "b", 1, "") for k in range(401)]
    out = M.mix(spark.createDataFrame(data, SCHEMA)).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("times").alias("t"))
    got = {r["good"]: r["t"] for r in out.collect()}
    assert got[1] >= got[0]


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_bins_follow_the_keys(spark, rounds):
    """Documents of the lowest quality have keys twenty times as far apart; few of them are left to order, and the result is the same."""
    data = [(k, "a ## $$ %% && ** " * 4 if k % 10 else "plain words", "low" if k < 3000 else "other", 1, "") for k in range(4500)]
    docs = spark.createDataFrame(data, SCHEMA)
    want = {tuple(r) for r in M.mix(docs).collect()}
    assert {tuple(r) for r in M.mix(docs, bins=64, rounds=rounds).collect()} == want
    sizes = M.weighted_sizes(docs)
    ends = sizes.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high")).selectExpr(
        "source s", "1L source_size", "1.0D target", "0 epochs", "900.0D rest", "low", "high", "0L base"
    )
    left = [sizes.count()]
    for _ in range(3):
        ends = M._narrowed(sizes, ends, 64)
        left.append(sizes.join(ends, F.col("source").eqNullSafe(F.col("s"))).where("key >= low AND key <= high").count())
    assert left[1] < left[0] / 4 and left[3] <= 4
