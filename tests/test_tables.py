from pyspark.sql import functions as F

from trawlspark.functions import http
from trawlspark.functions.text import format_bytes, format_elapsed
from trawlspark.operators import jobs
from trawlspark.sources import configs, tables


def test_elapsed_and_bytes(spark):
    second, minute, hour, day = 1000, 60_000, 3_600_000, 86_400_000
    elapsed = [
        (0, "0ms"), (999, "999ms"), (second, "1s"), (second + 1, "1s"), (minute, "1m"),
        (minute + 125, "1m"), (minute + second, "1m 1s"), (hour, "1h"), (hour + second, "1h 1s"),
        (hour + minute + second, "1h 1m 1s"), (day, "1d"), (day + minute + second, "1d 1m 1s"),
        (9752, "9s"), (minute * 5 + second * 59, "5m 59s"),
        (day * 13 + hour * 5 + minute * 42 + second * 23, "13d 5h 42m 23s"),
    ]
    df = spark.createDataFrame(elapsed, "ms long, want string")
    assert [r for r in df.withColumn("got", format_elapsed(F.col("ms"))).collect() if r.got != r.want] == []
    sizes = [(0, "0 b "), (999, "999 b "), (1000, "1.0 kB"), (1250, "1.3 kB"), (1_500_000, "1.5 MB"),
             (2_340_000_000, "2.3 GB")]
    df = spark.createDataFrame(sizes, "n long, want string")
    assert [r for r in df.withColumn("got", format_bytes(F.col("n"))).collect() if r.got != r.want] == []


def test_response_fields(spark):
    df = spark.createDataFrame(
        [({"Content-Type": ["text/html", "x"]}, bytearray("é".encode())), ({"content-type": ["text/css"]}, bytearray(b"123456"))],
        "headers map<string,array<string>>, content binary",
    )
    rows = df.select(
        http.first_header(F.col("headers"), "Content-Type").alias("ct"),
        http.body_text(F.col("content")).alias("body"),
        http.effective_status(F.lit(200), F.col("content"), 5).alias("status"),
    ).collect()
    assert [tuple(r) for r in rows] == [("text/html", "é", 200), (None, "123456", -1)]
    classes = spark.createDataFrame([(200,), (299,), (301,), (404,), (500,), (-1,), (100,)], "s int")
    assert [r[0] for r in classes.select(http.status_class(F.col("s"))).collect()] == [
        "success", "success", "redirect", "fail", "fail", "fail", "fail",
    ]


def test_document_round_trip(spark, tmp_path):
    rows = spark.range(200).select(
        F.lit("c").alias("crawler_id"),
        F.concat(F.lit("job"), F.col("id") % 5).alias("job_id"),
        F.concat(F.lit("http://s/"), "id").alias("uri"),
        F.when(F.col("id") % 2 == 0, "text/html").alias("content_type"),
        F.encode(F.col("id").cast("string"), "UTF-8").alias("content"),
        F.lit(3).alias("content_length"),
        (F.col("id") % 3).cast("int").alias("depth"),
        F.timestamp_millis(F.col("id")).alias("fetched"),
        F.lit(200).alias("status"),
    )
    docs, meta = str(tmp_path / "d"), str(tmp_path / "m")
    tables.write_documents(tables.document_rows(rows), docs)
    tables.write_metadata(tables.metadata_rows(rows), meta)
    doc = tables.find_document(spark, docs, "job1", "http://s/1").collect()
    assert [bytes(d.content) for d in doc] == [b"1"]
    assert doc[0].content_type == "undefined"
    listed = tables.metadata_of_job(spark, meta, "job2").collect()
    assert len(listed) == 40 and listed == sorted(listed, key=lambda r: (r.depth, r.fetched))
    assert listed[0].response_status == "200"
    plan = tables.of_job(spark, docs, "job1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_bucket" in plan and "EqualTo(job_id,job1)" in plan


def test_log_reads(spark, tmp_path):
    log = spark.createDataFrame(
        [("j", i, f"u{i}") for i in range(5)] + [("k", 9, "x")], "job_id string, s int, uri string"
    ).select("job_id", F.timestamp_seconds("s").alias("log_time"), "uri")
    path = str(tmp_path / "log")
    tables.write_log(log, path)
    assert [r.uri for r in tables.log_of_job(spark, path, "j").collect()] == ["u4", "u3", "u2", "u1", "u0"]
    assert [r.uri for r in tables.log_of_job(spark, path, "j", first=True).collect()] == ["u4"]


def test_job_layouts_and_reads(spark, tmp_path):
    rows = spark.range(60).select(
        (F.col("id") % 4).alias("crawler_id"), F.col("id").alias("job_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("partition_date"),
        F.col("id").alias("created_ms"),
    )
    day, crawler = str(tmp_path / "day"), str(tmp_path / "crawler")
    tables.write_jobs(rows, day, crawler)
    got = jobs.jobs_of_day(spark.read.parquet(day), "2024-01-02").collect()
    assert [r.job_id for r in got] == list(range(58, 0, -3))
    got = jobs.jobs_of_crawler(spark.read.parquet(crawler), 1).collect()
    assert [r.job_id for r in got] == list(range(57, 0, -4))
    assert jobs.jobs_of_day(spark.read.parquet(day)).count() == 0


def test_finished_snapshot_wins(spark):
    df = spark.createDataFrame(
        [(1, 10, None), (1, 20, 20), (1, 30, None), (2, 5, None), (2, 6, None)],
        "job_id int, snapshot_ms int, finished_ms int",
    )
    got = {r.job_id: r.snapshot_ms for r in jobs.latest_jobs(df).collect()}
    assert got == {1: 20, 2: 6}


def test_retention_and_upsert(spark):
    day = tables.DAY_MS
    df = spark.createDataFrame([(i, i * day) for i in range(40)], "id int, w long")
    asof = F.lit(39 * day)
    assert tables.retained(df, "fetch_log", "w", asof).count() == 8
    assert tables.retained(df, "document", "w", asof).count() == 31
    assert tables.retained(df, "crawler", "w", asof).count() == 40
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_configs(spark):
    text = (
        '{"id":"x","userAgent":"bot","seeds":["http://a"],"uriFilter":{"filterClass":"F",'
        '"rules":["accept: http://a"]},"crawlerName":"Zed","maxDepth":2,"maxRequestFails":0.25}'
    )
    df = spark.createDataFrame([("1", text), ("2", text.replace("Zed", "abc"))],
                               "crawler_id string, config_json string")
    parsed = configs.parse_configs(df)
    first = parsed.filter("crawler_id = '1'").first()
    assert (first.seeds, first.rule_lines, first.max_depth, first.max_request_fails, first.tests) == (
        ["http://a"], ["accept: http://a"], 2, 0.25, None)
    again = configs.parse_configs(parsed.select("crawler_id", configs.config_json().alias("config_json")))
    assert sorted(map(str, again.collect())) == sorted(map(str, parsed.collect()))
    assert [r.crawler_name for r in configs.all_configs(parsed).collect()] == ["abc", "Zed"]
    assert configs.find_config(df, "2").count() == 1
    left = configs.delete_configs(df, spark.createDataFrame([("1",)], "crawler_id string"))
    assert [r.crawler_id for r in left.collect()] == ["2"]
    bad = spark.createDataFrame([("1", "{nope")], "crawler_id string, config_json string")
    try:
        configs.parse_configs(bad).collect()
    except Exception as e:
        assert "MALFORMED" in str(e).upper()
    else:
        raise AssertionError("malformed JSON must fail")


def test_json_dates(spark):
    df = spark.range(1).select(F.timestamp_millis(F.lit(1500)).alias("t"))
    assert configs.rows_as_json(df).first().json == '{"t":"1970-01-01T00:00:01.500+0000"}'


def test_packed_media_counters(spark):
    df = spark.createDataFrame([({"text/html": "3,783"},)], "m map<string,string>")
    got = df.select(tables.unpack_media(F.col("m"))).first()[0]
    assert {k: tuple(v) for k, v in got.items()} == {"text/html": (3, 783)}
