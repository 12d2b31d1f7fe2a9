import glob
import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedloom.schema import POST_SCHEMA, SNAPSHOT_SCHEMA
from feedloom.session import run_dir, shared_dir
from feedloom.sinks import csv
from feedloom.sources.pages import land_pages, read_page_dumps, read_pages, store_snapshots, write_page_dumps

ROWS = [
    ('a, "quoted", b', "u,1", "2024-01-01T00:00:00.000Z", 1),
    ("line\nbreak\r\nand \\ back\\slash", "u", "", 2),
    ("#hash first", " padded ", None, 3),
    ("  leading", "", "3h", 4),
    ("trailing \t", "'single'", "x", 5),
    ('"', '""', "ü☃", 6),
    ("\\", "\\\"", "#", 7),
    (None, None, None, 8),
]


def files(folder):
    return sorted(glob.glob(os.path.join(folder, "**", "*.csv"), recursive=True))


def test_bytes_equal_pandas(spark, tmp_path):
    folder = str(tmp_path / "out")
    csv.write_csv(spark.createDataFrame(ROWS, POST_SCHEMA).coalesce(1), folder)
    (path,) = files(folder)
    want = pd.DataFrame(ROWS, columns=POST_SCHEMA.names).to_csv(index=False)
    assert open(path, newline="", encoding="utf-8").read() == want


def test_round_trip_up_to_empty_is_null(spark, tmp_path):
    folder = str(tmp_path / "out")
    csv.write_csv(spark.createDataFrame(ROWS, POST_SCHEMA), folder)
    got = [tuple(r) for r in csv.read_csv(spark, folder).orderBy("numero").collect()]
    want = [tuple(None if x == "" else x for x in r) for r in ROWS]
    # The reader takes any line end inside quotes as it is written, but \r\n as \n.
    assert [tuple(str(x).replace("\r\n", "\n") for x in r) for r in got] == [
        tuple(str(x).replace("\r\n", "\n") for x in r) for r in want
    ]


def test_empty_result_is_a_header(spark, tmp_path):
    folder = str(tmp_path / "out")
    csv.write_csv(csv.empty_result(spark).coalesce(1), folder)
    (path,) = files(folder)
    assert open(path).read() == "texto,usuario,timestamp,numero\n"
    assert csv.read_csv(spark, folder).schema == POST_SCHEMA


def test_per_target_files_are_in_order(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"t{n}", "u", "", n, "big" if n <= 400 else f"small/{n % 3}") for n in range(1, 431)]
    df = spark.createDataFrame(rows, "texto string, usuario string, timestamp string, numero long, file_name string")
    csv.write_per_target(df.repartition(7), folder, max_rows_per_file=150)
    assert len(os.listdir(folder)) - os.listdir(folder).count("_SUCCESS") - os.listdir(folder).count("._SUCCESS.crc") == 4
    spans = []
    for path in files(os.path.join(folder, "file_name=big")):
        numbers = pd.read_csv(path)["numero"].tolist()
        assert numbers == list(range(numbers[0], numbers[-1] + 1)) and len(numbers) <= 150
        spans.append((numbers[0], numbers[-1]))
    spans.sort()
    assert len(spans) > 2 and spans[0][0] == 1 and spans[-1][1] == 400
    assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_names(spark):
    df = spark.createDataFrame([(1, "hashtag", "a", "##x #"), (2, "user", "b", "@u@")], "i int, kind string, engine string, target string")
    got = csv.csv_file_names(df).orderBy("i").select("file_name").collect()
    assert [r[0] for r in got] == ["x _tweets.csv", "u_tweets_pw.csv"]
    stamped = df.select(csv.run_stamp_name("kind", F.lit("t"), F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")))
    assert stamped.collect()[0][0] == "hashtag_t_20240203_040506.csv"


def test_page_dumps(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a\nb</p>\n")
    (tmp_path / "b.html").write_text("<p>c</p>")
    got = read_page_dumps(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.path), r.html) for r in got) == [("a.html", "<p>a\nb</p>\n"), ("b.html", "<p>c</p>")]


def test_pages_are_read_where_they_lie(spark, sf_dir):
    plan = read_pages(spark, f"{sf_dir}/pages.parquet")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert run_dir(spark, "x").startswith(shared_dir(spark))


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_landed_pages_and_bucketed_snapshots(spark, tmp_path):
    """Landing keeps the rows and spreads them over files; a bucketed table's markup meets the asked addresses without an exchange."""
    rows = [(f"u{k % 40}", k // 40, f"u{k}", "ok", f"<p>{k}</p>") for k in range(400)]
    shots = spark.createDataFrame(rows, SNAPSHOT_SCHEMA).coalesce(1)
    landed = land_pages(shots, str(tmp_path / "landed"), rows_per_file=50)
    assert len(landed.inputFiles()) == 8 and landed.exceptAll(shots).count() == 0 and landed.count() == 400
    table = store_snapshots(shots, "snapshots_by_address", str(tmp_path / "table"), buckets=4)
    asked = spark.range(0, 30).select(F.concat(F.lit("u"), "id").alias("requested_url"))
    joined = table.join(asked.hint("merge"), "requested_url", "left_semi")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert joined.count() == 300
    spark.sql("DROP TABLE snapshots_by_address")


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_written_page_dumps(spark, tmp_path, scheme):
    """One file a page as Spark's own writer has them, rows of a task that share a page in one; a hundred folders are listed in few tasks."""
    rows = [(k, f"<p>{k} äöü</p>\n" + "x" * k) for k in range(100)] + [(7, "again"), (None, "no id"), (5000, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(2)
    place = str(tmp_path / "some place")
    write_page_dumps(pages, scheme + place)
    pages.write.partitionBy("page_id").option("lineSep", "\n").text(str(tmp_path / "spark"))

    def found(folder):
        every = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.input_file_name(), "value").collect()
        return sorted((re.search("page_id=([^/]+)/", r[0])[1], r[1]) for r in every)

    assert found(place) == found(str(tmp_path / "spark"))
    files = read_page_dumps(spark, scheme + place)
    assert files.rdd.getNumPartitions() <= 32 * spark.sparkContext.defaultParallelism
    got = files.where("path NOT LIKE '%DEFAULT%'").select(F.regexp_extract("path", r"page_id=(\d+)/", 1), "html").collect()
    assert sorted((k, html) for k, html in map(tuple, got)) == [x for x in found(place) if x[0].isdigit()]
    # No processes are started for a file, and no checksum files written.
    assert not [f for _, _, names in os.walk(place) for f in names if f.endswith(".crc") or f.startswith(".")]
    write_page_dumps(pages.limit(0), scheme + str(tmp_path / "none"))
    assert read_page_dumps(spark, scheme + str(tmp_path / "none")).count() == 0


def test_many_folders_are_listed_in_few_tasks(spark, tmp_path):
    write_page_dumps(spark.range(200).selectExpr("id AS page_id", "'x' AS html"), str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("lists", "lists")
    try:
        read_page_dumps(spark, str(tmp_path / "d"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lists")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    tasks = sum(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds)
    assert 0 < tasks <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
