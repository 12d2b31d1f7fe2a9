"""What the plans must look like to hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from feedloom import presets
from feedloom.operators import blocks
from feedloom.plans import jobs
from feedloom.schema import SNAPSHOT_SCHEMA
from feedloom.sources.requests import read_requests


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are for tables beyond the broadcast limit."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def stored(spark, tmp_path):
    html = "<article data-testid='tweet'><div data-testid='tweetText'>t</div></article>"
    row = ("https://x.com/a", 0, "https://x.com/a", "ok", html)
    spark.createDataFrame([row], SNAPSHOT_SCHEMA).write.parquet(str(tmp_path / "s"))
    asked = read_requests(spark, [{"kind": k, "engine": e, "target": "a"} for k in ("hashtag", "user") for e in "ab"])
    return asked, spark.read.parquet(str(tmp_path / "s"))


def nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_markup_is_never_shuffled_or_broadcast(spark, no_broadcast, stored):
    asked, snapshots = stored
    for job in (jobs.hashtag_posts_a, jobs.hashtag_posts_b, jobs.user_posts_a, jobs.user_posts_b):
        seen = 0
        for node in nodes(job(asked, snapshots, prune=False)._jdf.queryExecution().executedPlan()):
            columns = node.output().toString()
            seen += "html" in columns
            if "Exchange" in node.nodeName() or "Join" in node.nodeName():
                assert "html" not in columns, node.nodeName()
        assert seen


def test_extraction_runs_once_where_its_result_is_used_twice(spark, no_broadcast, stored):
    df = jobs.user_posts_b(*stored)
    assert [r.texto for r in df.collect()] == ["t"]
    final = plan_of(df)
    final = final[: final.index("\n+- == Initial Plan ==")]
    assert final.count("ArrowEvalPython") == 1


def test_failed_blocked_and_foreign_pages_are_left_out_in_the_scan(spark, stored):
    asked, snapshots = stored
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = jobs.hashtag_posts_a(asked, snapshots)._jdf.queryExecution().explainString(formatted)
    for part in (
        "EqualTo(status,ok)",
        "Not(StringContains(url,login))",
        "StringStartsWith(requested_url,https://x.com/hashtag/)",
        "LeftSemi",
    ):
        assert part in plan


def test_small_limits_can_be_cut_in_the_map_tasks(spark):
    rows = spark.range(100).selectExpr("id % 3 AS g", "id AS o")
    plan = plan_of(blocks.first_rows(rows, ["g"], "o", 3, cut_in_tasks=True))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "WindowGroupLimit" not in plan_of(blocks.first_rows(rows, ["g"], "o", 3))


def test_no_window_over_rows_of_a_whole_group(spark, sf_dir, no_broadcast):
    """Where rows are numbered, windows are by block; windows by group alone run on counted blocks."""
    for name in ("number_dense", "scroll_stop", "cap_candidates_negative", "first_nonempty_source"):
        plan = plan_of(entry.queries()[name](spark, sf_dir))
        for line in plan.splitlines():
            if re.search(r"\bWindow \[", line) and "row_number" in line:
                assert "_block" in line, line


def test_no_cartesian_products_and_no_sorting_aggregates_of_sightings(spark, sf_dir):
    for name, query in entry.queries().items():
        if name.startswith("stream") or name.startswith("csv") or name == "empty_result":
            continue
        plan = plan_of(query(spark, sf_dir))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    assert "SortAggregate" not in plan_of(entry.queries()["accumulate_distinct"](spark, sf_dir))


def test_scans_read_only_needed_columns(spark, sf_dir):
    for name, columns in [
        ("filter_blocked_pages", "page_id:bigint,url:string"),
        ("explode_cards_flat", "page_id:bigint,html:string"),
        ("group_has_any", "user_id:bigint,event_type:string"),
        ("cap_candidates", "conv_id:bigint,turn:bigint"),
    ]:
        assert f"ReadSchema: struct<{columns}>" in plan_of(entry.queries()[name](spark, sf_dir)), name


def test_presets_parse():
    from feedloom.functions.markup import Reader

    for spec in (presets.HASHTAG_A, presets.HASHTAG_B, presets.USER_A, presets.USER_B):
        assert Reader.of(spec).containers
