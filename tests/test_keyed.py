"""Tables by key and by day, robots files, the seen set: what is read, what is rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from trawlspark.operators import robots
from trawlspark.operators.seen import SeenSet
from trawlspark.sources.keyed import BUCKET, DayTable, KeyedTable
from trawlspark.sources.robots_files import read_robots_files, write_robots_files


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def keyed_rows(spark, ids, text):
    return spark.createDataFrame([(f"job-{i % 3}", f"http://s.com/{i}", text, i) for i in ids], "job_id string, uri string, body string, n int")


def test_upsert_rewrites_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "docs")
    table = KeyedTable(spark, path, ["job_id", "uri"], 16)
    table.upsert(keyed_rows(spark, range(200), "old"))
    before = files(path)
    table.upsert(keyed_rows(spark, [7, 8, 1000], "new"))
    touched = {r[0] for r in table._dealt(keyed_rows(spark, [7, 8, 1000], "")).select(BUCKET).collect()}
    assert 0 < len(touched) <= 3
    for name, time in files(path).items():
        kept = int(name.split(f"{BUCKET}=")[1].split("/")[0]) not in touched
        assert (before.get(name) == time) == kept
    got = {(r.uri, r.body) for r in table.read().collect()}
    assert len(got) == 201 and {u[13:] for u, b in got if b == "new"} == {"7", "8", "1000"}
    # made again with another number of folders: the stored one counts
    again = KeyedTable(spark, path, ["job_id", "uri"], 99)
    assert again.buckets == 16 and again.find(job_id="job-1", uri="http://s.com/7").first().body == "new"
    table.delete(keyed_rows(spark, range(0, 200), ""))
    assert [r.uri for r in table.read().collect()] == ["http://s.com/1000"]
    table.upsert(keyed_rows(spark, [], ""))
    assert table.read().count() == 1


def test_last_of_several_new_versions(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["id"], 4)
    rows = spark.createDataFrame([(1, "a", 1), (1, "c", 3), (1, "b", 2), (None, "x", 1), (None, "y", 2)], "id int, v string, n int")
    table.upsert(rows, ["n"])
    assert {(r.id, r.v) for r in table.read().collect()} == {(1, "c"), (None, "y")}


def test_missing_key_reads_no_row_group(spark, tmp_path):
    path = str(tmp_path / "docs")
    table = KeyedTable(spark, path, ["uri"], 1)
    rows = spark.range(20_000).select(F.concat(F.lit("http://s.com/"), F.col("id") * 2).alias("uri"), F.lit("x").alias("body"))
    table.upsert(rows)

    def scanned(uri):
        df = table.find(uri=uri)
        found = df.count()
        plan = df.groupBy().count()._jdf.queryExecution()
        plan.executedPlan().executeCollect()
        text = plan.executedPlan()
        leaves = text.collectLeaves()
        plans = [leaves.apply(i) for i in range(leaves.size())]
        final = [p.executedPlan() if "AdaptiveSparkPlan" in p.getClass().getName() else p for p in plans]
        out = 0
        for p in final:
            inner = p.collectLeaves()
            for i in range(inner.size()):
                leaf = inner.apply(i)
                while "QueryStage" in leaf.getClass().getName():
                    leaf = leaf.plan().collectLeaves().apply(0)
                out += leaf.metrics().apply("numOutputRows").value()
        return found, out

    # within the range of stored keys, so that minimum and maximum cannot rule it out
    found, read = scanned("http://s.com/10001")
    assert (found, read) == (0, 0)
    assert scanned("http://s.com/10002")[0] == 1


def test_expired_days_go_as_folders(spark, tmp_path):
    path, day = str(tmp_path / "log"), 86_400_000
    table = DayTable(spark, path, "fetch_log", "log_ms", buckets=2)
    table.append(spark.createDataFrame([(j, d * day + h) for j in range(4) for d in range(20) for h in (0, day // 2)], "job_id int, log_ms bigint"))
    asof = 17 * day + day // 4
    want = {(r.job_id, r.log_ms) for r in table.read(asof).collect()}
    assert want == {(j, d * day + h) for j in range(4) for d in range(20) for h in (0, day // 2) if d * day + h >= asof - 7 * day}
    before = files(path)
    assert table.drop_expired(asof) == [f"1970-01-{d + 1:02d}" for d in range(10)]
    after = files(path)
    assert all(before[name] == time for name, time in after.items()) and len(after) < len(before)
    assert {(r.job_id, r.log_ms) for r in table.read(asof).collect()} == want
    assert table.drop_expired(asof) == []


def test_robots_files(spark, tmp_path):
    path = str(tmp_path / "robots")
    rows = [("https://a.example:8443", "User-agent: *\r\nDisallow: /x"), ("http://01.20", "User-agent: *\nDisallow: /"), ("http://b.example", "")]
    write_robots_files(spark.createDataFrame(rows, "site string, body string"), path)
    got = {r.site: r.body.strip() for r in read_robots_files(spark, path).collect()}
    assert got == {s: b.strip() for s, b in rows}
    rules = robots.robots_rules(read_robots_files(spark, path), "bot")
    uris = [(s + p, s, p, "bot") for s in ("https://a.example:8443", "http://01.20", "http://none.example") for p in ("/x", "/y")]
    allowed = robots.robots_allow(spark.createDataFrame(uris, "uri string, site string, path string, user_agent string"), rules)
    assert {r.uri for r in allowed.collect() if r.allowed} == {"https://a.example:8443/y", "http://none.example/x", "http://none.example/y"}


def test_seen_side_is_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = SeenSet(spark)
    rows = spark.range(1000).selectExpr("id % 3 AS job_id", "concat('/', id) AS uri")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert seen.unseen(rows).count() == 1000
        seen.add(rows.filter("id < 400"))
        seen.add(rows.filter("id BETWEEN 400 AND 599"))
        left = seen.unseen(rows)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert {r.uri for r in left.collect()} == {f"/{i}" for i in range(600, 1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        seen.drop()


@pytest.mark.parametrize("keep", [0, 1])
def test_journal_compaction(spark, tmp_path, keep):
    from trawlspark.streaming import journal as J

    path = str(tmp_path)
    schema = "job_id int, uri string, event_id bigint, row_no bigint, content string"
    for batch, rows in enumerate([[(1, "a", 1, 0, "old"), (1, "b", 2, 1, "b")], [(1, "a", 3, 0, "twice"), (1, "a", 4, 1, "new")], [(2, "a", 5, 0, "x"), (2, "a", 5, 1, "y")]]):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/document/batch_id={batch}")

    def contents():
        return {(r.job_id, r.uri, r.content) for r in J.journal_table(spark, path, "document").collect()}

    want = {(1, "a", "new"), (1, "b", "b"), (2, "a", "y")}
    plan = J.journal_table(spark, path, "document")._jdf.queryExecution().executedPlan().toString()
    for line in plan.split("\n"):
        assert "content" not in line or not any(k in line for k in ("Sort", "Aggregate")), line
    assert contents() == want
    assert J.compact(spark, path, "document", keep) == 2 - keep and contents() == want
    assert J.stored_rows(spark, path, "document").count() == (3 if keep == 0 else 4)
    assert J.compact(spark, path, "document", keep) == 2 - keep and contents() == want
    spark.createDataFrame([(1, "b", 6, 0, "late")], schema).write.parquet(f"{path}/document/batch_id=3")
    assert contents() == {(1, "a", "new"), (1, "b", "late"), (2, "a", "y")}
