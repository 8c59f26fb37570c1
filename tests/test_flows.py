"""Results, sources, sinks, logs and streams."""

import json

from pyspark.sql import functions as F

from shelfscan.operators import health as hl
from shelfscan.operators import logs as lg
from shelfscan.operators import products as pr
from shelfscan.operators import requests as rq
from shelfscan.operators import results as rs
from shelfscan.operators import retry as rt
from shelfscan.sources import readers, writers


def product_rows(spark, pages=5, per_page=3):
    rows = [("m", "café", p, i, f"t{p}-{i}") for p in range(1, pages + 1) for i in range(1, per_page + 1)]
    found = spark.createDataFrame(rows, "platform string, search_term string, page_number int, position_on_page int, title string")
    return pr.normalise_products(found, ["platform", "search_term"])


def results(spark):
    products = product_rows(spark)
    searches = spark.createDataFrame(
        [("m", "café", True, None), ("m", "nada", True, "")],
        "platform string, search_term string, success boolean, error_message string",
    ).withColumns({"timestamp": F.lit("2025-01-01").cast("timestamp"), "execution_time": F.lit(1.5)})
    pages = products.select("platform", "search_term", "page_number").distinct()
    return rs.search_results(searches, pages, products)


def test_results_are_ordered_and_complete(spark):
    rows = {r.search_term: r for r in results(spark).collect()}
    assert [p.title for p in rows["café"].products] == [f"t{p}-{i}" for p in range(1, 6) for i in range(1, 4)]
    assert (rows["café"].total_products, rows["café"].pages_crawled) == (15, 5)
    assert (rows["nada"].total_products, rows["nada"].products) == (0, [])


def test_error_rows_and_summary(spark):
    errors = spark.createDataFrame([("x", "m", "boom", "NetworkException")], "search_term string, platform string, error_message string, error_type string")
    rows = {r.search_term: r for r in rs.search_summary(rs.error_results(errors, results(spark))).collect()}
    assert (rows["x"].status, rows["x"].total_products, rows["x"].error_message) == ("Error", 0, "boom")
    assert (rows["café"].status, rows["nada"].error_message) == ("Success", "N/A")


def test_json_round_trip(spark, tmp_path):
    path = str(tmp_path / "json")
    writers.write_results_json(results(spark).withColumn("platform", F.lit(None).cast("string")), path)
    back = readers.read_results(spark, path, multiline=False)
    assert {r.platform for r in back.collect()} == {"unknown"}
    flat = readers.explode_results(back)
    assert flat.count() == 16 and flat.filter("title is null").count() == 1
    raw = spark.read.text(path).filter("value like '%café%'").count()
    assert raw == 1


def test_older_result_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps({"search_term": "x", "total_products": 1, "pages_crawled": 1, "success": True,
                    "products": [{"title": "é", "page_number": 1}]}, indent=2, ensure_ascii=False),
        encoding="utf-8",
    )
    row = readers.read_results(spark, str(tmp_path)).first()
    assert row.platform is None and row.products[0].title == "é" and row.products[0].price is None


def test_report(spark, tmp_path):
    path = str(tmp_path / "report")
    writers.write_report(results(spark), path, keys=["search_term"])
    assert spark.read.parquet(path + "/summary").count() == 2
    products = spark.read.parquet(path + "/products")
    assert products.columns == ["search_term", *pr.PRODUCT_COLUMNS]
    assert {r.search_term for r in products.collect()} == {"café"}


LINES = [
    "2025-09-18 11:18:53 - src.main - INFO - Iniciando busca por: cafeína",
    "2025-09-18 11:19:16 - src.main - INFO - Página 1: Layout detectado: poly-card",
    "2025-09-18 11:19:16 - src.main - INFO - Página 1: 57 containers encontrados",
    "2025-09-18 11:19:17 - src.main - INFO - Página 1: 55 produtos extraídos",
    "2025-09-18 11:19:17,123 - ERROR - Erro na execução: No module",
    "  File \"x.py\", line 3",
    "2025-09-18T13:44:53.000001Z - INFO     - app - run:12 - [iphone 15][Página 3] Starting search for: iphone 15",
    "2025-09-18T13:44:55.000001Z - WARNING  - [iphone 15] Page 2: 7 products extracted",
]


def test_run_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LINES), encoding="utf-8")
    logs = readers.read_run_log(spark, str(tmp_path))
    rows = logs.orderBy("block", "line").collect()
    assert [r.level for r in rows] == ["INFO"] * 4 + ["ERROR", None, "INFO", "WARNING"]
    assert (rows[6].logger, rows[6].search_term, rows[6].page_number) == ("app", "iphone 15", 3)
    assert rows[4].message == "Erro na execução: No module" and rows[4].logger is None
    runs = lg.log_runs(lg.with_run(logs)).orderBy("run").collect()
    assert [(r.search_term, r.duration_seconds, r.products, r.outcome) for r in runs] == [
        ("cafeína", 24, 55, "error"), ("iphone 15", 2, 7, "success"),
    ]
    pages = lg.log_page_stats(lg.with_run(logs)).orderBy("run").collect()
    assert [(r.page, r.layout, r.containers, r.products) for r in pages] == [(1, "poly-card", 57, 55), (2, None, None, 7)]
    assert lg.at_least(logs, "error").count() == 1


def test_records_go_on_over_lines_and_splits(spark, tmp_path):
    lines = ["stray", "ValueError: before any record"]
    for i in range(40):
        lines.append(f"2025-09-18 11:19:{i:02} - app - {'ERROR' if i % 4 == 0 else 'INFO'} - step {i} of the run")
        if i % 4 == 0:
            lines += ["Traceback (most recent call last):", '  File "a.py", line 3, in go', "    go()", "KeyError: 'first'", "",
                      "During handling of the above exception, another exception occurred:", "",
                      f"app.errors.Late{i % 8}: waited" if i % 3 else "TimeoutError", "    "]
    (tmp_path / "a.log").write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = readers.read_log_records(spark, str(tmp_path))
        rows = found.orderBy("block", "line").collect()
        errors = {(r.error, r.records) for r in lg.log_errors(found).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block for r in rows}) > 5
    assert rows[0].level is None and rows[0].more_lines == 2 and rows[0].exception.type == "ValueError"
    records = sorted(rows[1:], key=lambda r: r.ts)
    assert [r.message for r in records] == [f"step {i} of the run" for i in range(40)]
    for i, r in enumerate(records):
        if i % 4:
            assert (r.more_lines, r.exception) == (0, None)
        else:
            want = (f"Late{i % 8}", "waited") if i % 3 else ("TimeoutError", None)
            assert r.more_lines == 9 and tuple(r.exception) == want
    assert errors == {("TimeoutError", 4), ("Late4", 3), ("Late0", 3)}


def test_html_files_as_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>\nhi\n</p>", encoding="utf-8")
    row = readers.read_pages(spark, str(tmp_path), "text").first()
    assert row.html == "<p>\nhi\n</p>" and row.url.endswith("p.html")


def requests(spark):
    return spark.createDataFrame(
        [("h", 0.0, 1.0, True), ("h", 2.0, 4.0, False), ("g", 1.0, 1.5, True)],
        "host string, s double, e double, success boolean",
    ).withColumns({
        "start_time": F.timestamp_micros((F.col("s") * 1e6).cast("long")),
        "end_time": F.timestamp_micros((F.col("e") * 1e6).cast("long")),
        "response_size": F.lit(10).cast("long"), "error_type": F.lit(None).cast("string"), "retry_count": F.lit(0),
    })


def test_whole_table_reports_without_keys(spark):
    now = "1970-01-01 00:05:00"
    report = rq.request_report(requests(spark), now, 10).first()
    assert (report.total_requests, report.failed_requests, report.p50_ms, report.p95_ms) == (3, 1, 1000.0, 2000.0)
    totals = rq.request_totals(requests(spark)).first()
    assert (totals.total, totals.successful, totals.total_bytes_downloaded) == (3, 2, 30)
    assert rq.request_report(requests(spark), "1990-01-01", 10).count() in (0, 1)


def test_report_without_samples_is_an_error_row(spark):
    samples = spark.createDataFrame([], "host string, ts timestamp, memory_usage_mb double, cpu_percent double")
    rows = rq.performance_report(samples, requests(spark), ["host"], "1970-01-01 00:05:00").collect()
    assert {r.host for r in rows} == {"h", "g"}
    assert all(r.error == rq.INSUFFICIENT and r.total_requests is None for r in rows)


def test_health_of_an_idle_host(spark):
    stats = spark.sql(
        "select 'h' host, 600D memory_usage_mb, 70 cpu_percent, 5 open_files, cast(null as double) success_rate_percent,"
        " cast(null as double) avg_response_time_ms, 0L total, 0L failed"
    )
    checks = {r.name: r.status for r in hl.health_checks(stats, ["host"]).collect()}
    assert checks == {
        "memory_usage": "critical", "cpu_usage": "warning", "request_performance": "ok", "error_rates": "ok",
        "system_resources": "ok",
    }
    frame = hl.health_checks(stats, ["host"])
    assert hl.overall_status(frame, ["host"]).first().overall_status == "critical"
    action = hl.recommended_actions(frame).first()
    assert (action.action, action.cleanup_mode) == ("high_memory", "aggressive")


def test_circuit_by_policy(spark):
    rows = [("c", i, p, False) for i, p in enumerate(["a", "b", "a", None, "x", "a"])]
    attempts = spark.createDataFrame(rows, "call string, ts int, policy string, success boolean")
    policies = rt.policy_table(spark, [
        ("a", 3, 1.0, 1.0, "fixed", False, [], [], [], 3), ("b", 3, 1.0, 1.0, "fixed", False, [], [], [], 1),
        ("default", 3, 1.0, 1.0, "fixed", False, [], [], [], 5),
    ])
    state = rt.circuit_state(attempts, ["call"], policies, ["ts"], bucket=F.floor(F.col("ts") / 2))
    got = [(r.failure_run, r.circuit_open) for r in state.orderBy("ts").collect()]
    assert got == [(1, False), (2, True), (3, True), (4, False), (5, False), (6, True)]


def test_report_counts_errors(spark):
    rows = requests(spark)
    samples = spark.sql("select 'h' host, timestamp_seconds(3) ts, 1D memory_usage_mb, 2D cpu_percent")
    report = {r.host: r for r in rq.performance_report(samples, rows, ["host"], "1970-01-01 00:05:00").collect()}
    assert report["h"].errors == {"Unknown": 1} and report["g"].errors is None
    now = {r.host: r for r in rq.current_metrics(samples, rows, ["host"]).collect()}
    assert (now["h"].total, now["h"].failed, now["h"].success_rate_percent) == (2, 1, 50.0)
    assert now["g"].system is None and now["h"].system.cpu_percent == 2.0
