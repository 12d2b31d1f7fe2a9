"""The four jobs over made-up captures, against the request-by-request procedure written out in Python."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom import presets
from feedloom.functions.urls import made_from
from feedloom.plans import jobs
from feedloom.schema import SNAPSHOT_SCHEMA
from feedloom.sources.requests import candidate_urls, read_requests, with_defaults

TAGS = ["spark", "Flink", "go"]
USERS = ["ann", "bob", "cy", "dee"]


def make_post(rng):
    text = " ".join(rng.choices(["spark", "FLINK", "go", "x", "y"], k=rng.randint(0, 3)))
    return {
        "text": rng.choice([text, text, text, None]),
        "user": rng.choice(["@ann", "b o b", None]),
        "time": rng.choice(["t1", "t2", None, "none"]),
    }


def to_html(posts):
    out = []
    for p in posts:
        parts = ["<article data-testid='tweet'>"]
        if p["user"] is not None:
            parts.append(f"<div data-testid='User-Name'><span>{p['user']}</span></div>")
        if p["text"] is not None:
            parts.append(f"<div data-testid='tweetText'>{p['text']}</div>")
        if p["time"] == "none":
            parts.append("<time>3h</time>")
        elif p["time"] is not None:
            parts.append(f"<time datetime='{p['time']}'>9h</time>")
        out.append("".join([*parts, "</article>"]))
    return "<html><body>" + "".join(out) + "</body></html>"


def whole(p):
    shown = [p["user"], p["text"], {"none": "3h", None: None}.get(p["time"], "9h")]
    return [s for s in shown if s]


def stamp(p):
    return {None: "", "none": None}.get(p["time"], p["time"])


def fields(p, mode):
    """(text, user, time) or None where the mode drops the card."""
    if mode == "A_strict":
        return None if None in (p["text"], p["user"], p["time"]) else (p["text"], p["user"], stamp(p))
    user = p["user"] or "Unknown"
    if mode == "B_plain":
        return (p["text"], user, stamp(p)) if p["text"] else None
    if mode == "A_lenient":
        text = p["text"] or "\n".join(whole(p))
        return (text, user, stamp(p)) if text else None
    text = p["text"] or "\n".join(whole(p))
    when = {None: "", "none": "3h"}.get(p["time"], p["time"])
    return (text, user.replace("@", ""), when) if text else None


def page_rule(posts, mode, engine, most, least, term=None):
    found = []
    for i, p in enumerate(posts[:most], 1):
        f = fields(p, mode)
        if f is not None and (term is None or term.lower() in f[0].lower()):
            found.append((*f, i))
            if engine == "a" and len(found) >= least:
                break
        if engine == "b" and len(found) >= least:
            break
    return found


def captures_of(captures, url, scrolls):
    """The capture after the last allowed scroll, among those that did not fail or end at a sign-in page."""
    ok = [c for c in captures.get(url, []) if c["status"] == "ok" and "login" not in c["url"]]
    ok = [c for c in ok if c["scroll"] <= max(scrolls, 0)]
    return max(ok, key=lambda c: c["scroll"])["posts"] if ok else []


def expected(req, urls, captures):
    kind, engine, most, least, scrolls, term = req
    if kind == "hashtag":
        mode = "A_lenient" if engine == "a" else "B_plain"
        for url in urls:
            got = page_rule(captures_of(captures, url, scrolls), mode, engine, most, least, term if engine == "a" else None)
            if got:
                return got
        return []
    if engine == "a":
        tries = [c for c in captures.get(urls[0], []) if c["status"] == "ok" and c["scroll"] <= max(scrolls, 0)]
        posts = max(tries, key=lambda c: c["scroll"])["posts"] if tries else []
        return page_rule(posts, "A_strict", "a", most, least)
    chosen = None
    for i, url in enumerate(urls, 1):
        landing = [c for c in captures.get(url, []) if c["scroll"] == 0]
        if i == len(urls) or (landing and "login" not in landing[0]["url"]):
            chosen = url
            break
    pages = {c["scroll"]: c["posts"] for c in captures.get(chosen, []) if c["status"] == "ok"}
    if 0 not in pages:
        return []
    found, n = [], 0
    while len(found) < most and n < scrolls and pages and n <= max(pages):
        for p in pages.get(n, []):
            f = fields(p, "B_visible")
            if f is not None and f not in found:
                found.append(f)
        if len(found) >= least and n > 0:
            break
        n += 1
    return [(*f, i) for i, f in enumerate(found, 1)]


def build(spark, seed):
    rng = random.Random(seed)
    asked = []
    for kind, names, sigil in (("hashtag", TAGS, "#"), ("user", USERS, "@")):
        for engine in "ab":
            for name in names:
                for _ in range(4):
                    asked.append(
                        {
                            "kind": kind,
                            "engine": engine,
                            "target": rng.choice(["", " "]) + rng.choice(["", sigil]) + name,
                            "max_tweets": rng.choice([None, 0, 2, 5, -2]),
                            "min_tweets": rng.choice([None, 0, 1, 3, -1]),
                            "max_scrolls": rng.choice([None, 0, 1, 3]),
                        }
                    )
    requests = read_requests(spark, asked)
    urls = {}
    for r in candidate_urls(with_defaults(requests)).collect():
        urls.setdefault(r.req_id, {})[r.priority] = r.requested_url
    captures = {}
    for url in sorted({u for by in urls.values() for u in by.values()}):
        if rng.random() < 0.15:
            continue
        blocked = rng.random() < 0.25
        captures[url] = [
            {
                "scroll": s,
                "url": url.split("/", 3)[0] + "//x.com/i/flow/login" if blocked else url,
                "status": "ok" if rng.random() < 0.9 or s == 0 else "timeout",
                "posts": [make_post(rng) for _ in range(rng.choice([0, 1, 4, 8]))],
            }
            for s in range(rng.randint(1, 5))
        ]
    rows = [
        (url, c["scroll"], c["url"], c["status"], to_html(c["posts"]))
        for url, cs in captures.items()
        for c in cs
    ]
    rng.shuffle(rows)
    snapshots = spark.createDataFrame(rows, SNAPSHOT_SCHEMA)
    want = {}
    for r in with_defaults(requests).collect():
        req = (r.kind, r.engine, r.max_tweets, r.min_tweets, r.max_scrolls, r.clean)
        by = urls[r.req_id]
        want[r.req_id] = expected(req, [by[i] for i in sorted(by)], captures)
    return requests, snapshots, want


def collect(df):
    got = {}
    for r in df.orderBy("req_id", "numero").collect():
        got.setdefault(r.req_id, []).append((r.texto, r.usuario, r.timestamp, r.numero))
    return got


@pytest.mark.parametrize("seed", [21, 22])
def test_all_jobs_equal_the_procedure(spark, seed):
    requests, snapshots, want = build(spark, seed)
    results = jobs.run_requests(requests, snapshots)
    got = collect(results)

    def squeeze(results):
        """Texts without blanks: how a whole card is broken into lines is tested elsewhere."""
        return {
            k: [("".join(t.split()), *rest) for t, *rest in v] for k, v in results.items() if v
        }

    assert squeeze(got) == squeeze(want)
    report = {r.req_id: r for r in jobs.run_report(requests, results).collect()}
    assert {k: r.n_rows for k, r in report.items()} == {k: len(v) for k, v in want.items()}
    least = {r.req_id: r.min_tweets for r in with_defaults(requests).collect()}
    assert all(r.short_of_min == (r.n_rows < least[k]) for k, r in report.items())


def test_extracted_snapshots_give_the_same(spark):
    requests, snapshots, want = build(spark, 23)
    users = requests.where("kind = 'user' and engine = 'b'")
    kept = jobs.extract_snapshots(snapshots, presets.USER_B)
    assert "html" not in kept.columns
    assert collect(jobs.user_posts_b(users, kept)) == collect(jobs.user_posts_b(users, snapshots))
    tags = requests.where("kind = 'hashtag' and engine = 'a'")
    kept = jobs.extract_snapshots(snapshots, presets.HASHTAG_A)
    assert collect(jobs.hashtag_posts_a(tags, kept)) == collect(jobs.hashtag_posts_a(tags, snapshots))


def test_only_requested_changes_nothing_but_the_pages_read(spark):
    requests, snapshots, _ = build(spark, 24)
    some = requests.where("kind = 'hashtag' and engine = 'b' and target like '%go'")
    candidates = jobs.candidates_of(some)
    fewer = jobs.only_requested(snapshots, candidates)
    assert 0 < fewer.count() < snapshots.count()
    want = collect(jobs.hashtag_posts_b(some, snapshots, prune=False))
    assert want and collect(jobs.hashtag_posts_b(some, snapshots)) == want
    assert collect(jobs.hashtag_posts_b(some, fewer, prune=False)) == want


def test_one_plan_for_any_number_of_addresses(spark):
    _, snapshots, _ = build(spark, 24)

    def plan(n):
        asked = spark.range(n).selectExpr("concat('https://x/', id) AS requested_url")
        text = jobs.only_requested(snapshots, asked)._jdf.queryExecution().optimizedPlan().toString()
        return [line.split("[")[0].split("(")[0].strip(" :+-") for line in text.splitlines()]

    assert plan(10) == plan(200_000)


def test_failed_requests(spark):
    asked = read_requests(spark, [{"kind": "user", "target": t} for t in ("@a", "b", "c")])
    rows = [
        ("https://twitter.com/a", 0, "https://twitter.com/a", "ok", ""),
        ("https://twitter.com/b", 0, "https://twitter.com/b", "timeout", ""),
    ]
    failed = jobs.failed_requests(asked, spark.createDataFrame(rows, SNAPSHOT_SCHEMA))
    assert sorted(r.target for r in failed.collect()) == ["b", "c"]


def test_page_report(spark):
    asked = read_requests(spark, [{"kind": "hashtag", "target": "go", "max_tweets": 2, "min_tweets": 5}])
    posts = [{"text": t, "user": None, "time": None} for t in ("go", "x", "go")]
    url = presets.HASHTAG_URLS_A[1].replace("{t}", "go")
    snapshots = spark.createDataFrame([(url, 0, url, "ok", to_html(posts))], SNAPSHOT_SCHEMA)
    results = jobs.page_results(asked, snapshots, presets.HASHTAG_A, "a", True)
    assert [tuple(r) for r in jobs.page_report(results).collect()] == [(1, 2, 3, 2, 1, True)]


def test_no_requests_and_no_pages(spark):
    requests, snapshots, _ = build(spark, 25)
    none = requests.where("req_id < 0")
    assert jobs.run_requests(none, snapshots).count() == 0
    assert jobs.run_requests(requests, snapshots.where(F.lit(False))).count() == 0
    assert jobs.run_requests(none, snapshots).columns == ["req_id", "texto", "usuario", "timestamp", "numero"]


def test_profile_templates_leave_out_searches(spark):
    urls = ["https://twitter.com/ana", "https://twitter.com/hashtag/x?src=hashtag_click", "https://twitter.com/search?q=%23x&src=typed_query&f=top", "https://x.com/ana"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string")

    def kept(templates):
        return [r[0] for r in rows.where(made_from("u", templates)).collect()]

    assert kept(presets.USER_URLS_A) == urls[:1]
    assert kept(presets.HASHTAG_URLS_A) == urls[1:3]
    assert kept((*presets.USER_URLS_A, *presets.HASHTAG_URLS_A)) == urls[:3]


def test_one_extraction_equals_four(spark):
    """Requests of all kinds over one table give what each job gives by itself, with and without pruning."""
    post = "<article data-testid='tweet'><div data-testid='User-Name'><span>@u</span></div><div data-testid='tweetText'>{}</div><time datetime='t'></time></article>"
    asked = read_requests(spark, [{"kind": k, "engine": e, "target": "spark", "max_tweets": 3, "min_tweets": 2} for k in ("hashtag", "user") for e in "ab"])
    urls = [t.format(t="spark") for t in (*presets.HASHTAG_URLS_A, *presets.USER_URLS_B)] + ["https://twitter.com/other"]
    rows = [(u, s, u, "ok" if i else "error", "".join(post.format(f"spark {i} {s} {k}") for k in range(4))) for i, u in enumerate(urls) for s in range(2)]
    shots = spark.createDataFrame(rows, SNAPSHOT_SCHEMA)
    each = [jobs.hashtag_posts_a, jobs.hashtag_posts_b, jobs.user_posts_a, jobs.user_posts_b]
    kinds = [("hashtag", "a"), ("hashtag", "b"), ("user", "a"), ("user", "b")]
    alone = [job(asked.where((F.col("kind") == k) & (F.col("engine") == e)), shots) for job, (k, e) in zip(each, kinds)]
    want = sorted(tuple(r) for df in alone for r in df.select(*jobs.RESULT_COLUMNS).collect())
    assert want
    for prune in (True, False):
        got = jobs.run_requests(asked, shots, prune=prune)
        assert sorted(map(tuple, got.collect())) == want
        assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_page_asked_very_often_is_spread(spark):
    """One page, 20,000 equal requests: its posts are worked out once a salt, and no task gets more than a few salts' requests."""
    post = "<article data-testid='tweet'><div data-testid='tweetText'>{}</div></article>"
    shots = spark.createDataFrame([(u.format(t="spark"), 0, "x", "ok", post.format("spark a") + post.format("spark b")) for u in presets.HASHTAG_URLS_A[:1]], SNAPSHOT_SCHEMA)
    asked = spark.range(20000).select(
        F.col("id").alias("req_id"), F.lit("hashtag").alias("kind"), F.lit("a").alias("engine"), F.lit("#spark").alias("target"),
        *[F.lit(None).cast("int").alias(c) for c in ("max_tweets", "min_tweets", "max_scrolls")],
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "32")):
        spark.conf.set(k, v)
    try:
        results = jobs.page_results(asked, shots, presets.HASHTAG_A, "a", True)
        assert results.count() == 20000
        parts = [r[0] for r in results.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
        assert len(parts) > 16 and max(parts) < 20000 / 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs.hashtag_posts_a(asked, shots).count() == 40000
