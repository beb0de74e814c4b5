import json

from feedlake.sources import accesslog

LINES = [
    ("info", "Incoming GET /articles - 127.0.0.1 - Mozilla/5.0 (X11) - beta"),
    ("info", "Incoming GET /articles - 127.0.0.1 - "),
    ("info", "Completed GET /articles - 200 - 12ms"),
    ("info", "Completed GET /articles - 200 - 20ms"),
    ("info", "Completed POST /articles/scrape - 201 - 7ms"),
    ("info", "Completed PUT /x - 200 - 1ms"),
    ("info", "Completed DELETE /x - 204 - 1ms"),
    ("error", "Failed GET /articles/9 - 404 - 3ms - Article not found - id 9"),
    ("error", "Failed GET /articles/9 - undefined - 3ms - boom"),
    ("info", "Starting hourly scraping..."),
]


def read(spark, tmp_path):
    log = tmp_path / "combined.log"
    log.write_text(
        "\n".join(
            json.dumps({"level": lv, "message": m, "timestamp": f"2024-01-01T00:00:{i:02d}Z"})
            for i, (lv, m) in enumerate(LINES)
        )
    )
    return accesslog.read_access_log(spark, str(log))


def test_parse(spark, tmp_path):
    parsed = accesslog.parse_access_log(read(spark, tmp_path)).orderBy("timestamp").collect()
    fields = "outcome method url ip user_agent status duration_ms error".split()
    rows = [tuple(r[f] for f in fields) for r in parsed]
    local = "127.0.0.1"
    assert rows == [
        ("Incoming", "GET", "/articles", local, "Mozilla/5.0 (X11) - beta", None, None, None),
        ("Incoming", "GET", "/articles", local, "", None, None, None),
        ("Completed", "GET", "/articles", None, None, 200, 12, None),
        ("Completed", "GET", "/articles", None, None, 200, 20, None),
        ("Completed", "POST", "/articles/scrape", None, None, 201, 7, None),
        ("Completed", "PUT", "/x", None, None, 200, 1, None),
        ("Completed", "DELETE", "/x", None, None, 204, 1, None),
        ("Failed", "GET", "/articles/9", None, None, 404, 3, "Article not found - id 9"),
        ("Failed", "GET", "/articles/9", None, None, 500, 3, "boom"),
    ]


def test_errors_and_durations(spark, tmp_path):
    lines = read(spark, tmp_path)
    assert accesslog.error_events(lines).count() == 2
    took = accesslog.request_durations(accesslog.parse_access_log(lines)).collect()
    by_key = {(r["method"], r["url"], r["outcome"]): r for r in took}
    row = by_key["GET", "/articles", "Completed"]
    assert (row["requests"], row["avg_ms"], row["max_ms"], row["p95_ms"]) == (2, 16.0, 20, 20)
    assert by_key["GET", "/articles/9", "Failed"]["requests"] == 2
    assert len(by_key) == 5


def test_histograms_add_up_and_stay_within_their_bound(spark):
    import random

    rng = random.Random(3)
    rows = [("GET", f"/u{n % 3}", "Completed", n % 24, int(rng.lognormvariate(5, 3))) for n in range(6000)]
    rows += [("GET", "/u0", "Completed", 1, None), ("POST", "/u", "Incoming", 1, None), ("GET", "/z", "Failed", 2, 0)]
    requests = spark.createDataFrame(rows, "method string, url string, outcome string, hour int, duration_ms long")
    hourly = accesslog.duration_histogram(requests, "hour")
    whole = accesslog.duration_histogram(requests)
    assert sorted(map(tuple, accesslog.merged_histogram(hourly).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    exact = {r["url"]: (r["requests"], r["p95_ms"]) for r in accesslog.request_durations(requests).collect()}
    for r in accesslog.histogram_durations(hourly).collect():
        requests_, p95 = exact[r["url"]]
        assert r["requests"] == requests_
        assert abs(r["quantile_ms"] - p95) <= p95 * accesslog.BUCKET_ERROR + 0.5
