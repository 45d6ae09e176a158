"""Data sources over web services, against the tables that a server of the test's own serves."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrand.plans import service_queries as Q
from lodestrand.plans.served import Served
from lodestrand.sources import services

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def web(spark):
    services.register(spark)
    server = Served(SF)
    yield server
    server.server.shutdown()


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").cache()


def paged(spark, web, **options):
    base = {"url": f"{web.url}/rows/events", "rows": "result.items", "total": "result.total", "offset": "offset", "page_size": "70", "range_rows": "200", "pushed": json.dumps({"event_type": "type", "ts": ["from", "to"]})}
    return spark.read.format("paged").schema(Q._EVENT).options(**{**base, **options})


def test_ranges_are_partitions_and_filters_reach_the_service(spark, web, events):
    n = events.count()
    rows = paged(spark, web).load()
    assert rows.rdd.getNumPartitions() == -(-n // 200) and rows.count() == n
    web.requests.clear()
    kept = rows.where("event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 00:00:00Z' AND value > 3")
    want = {r.event_id for r in events.where("event_type = 'click' AND ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND value > 3").collect()}
    assert {r.event_id for r in kept.collect()} == want
    assert all("type=click" in x and "from=2024-01-10" in x for x in web.requests)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    condition = plan[plan.index("Filter") :].split("\n")[0]
    assert "value" in condition and "click" not in condition and "2024" not in condition  # what was pushed isn't compared again


def test_tokens_most_and_queries(spark, web, events):
    options = {"url": f"{web.url}/feed/events", "rows": "rows", "page_size": "64"}
    reader = spark.read.format("paged").schema(f"{Q._EVENT}, query string").options(**options, queries='["a", "b"]')
    rows = reader.load()
    assert rows.rdd.getNumPartitions() == 2
    n = events.count()
    assert {r["query"]: r["count"] for r in rows.groupBy("query").count().collect()} == {"a": n, "b": n}
    assert reader.option("most", "100").load().groupBy("query").count().select("count").distinct().collect()[0][0] == 100


def test_a_stream_goes_on_from_its_token(spark, web, events, tmp_path):
    n = events.count()
    for opaque in ("", '{"opaque": "1"}'):
        base, options = f"{tmp_path}/{len(opaque)}", {"url": f"{web.url}/feed/events", "head": f"{web.url}/feed/events/head", "range_rows": "150", "page_size": "64", **({"params": opaque} if opaque else {})}

        def run():
            rows = spark.readStream.format("paged").schema(Q._EVENT).options(**options).load()
            rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
            return spark.read.parquet(f"{base}/rows").select("event_id").rdd.map(lambda r: r[0]).collect()

        first = [r.event_id for r in events.orderBy("event_id").select("event_id").collect()]
        for shown in (320, 320, 700, n):
            web.shown["events"] = shown
            web.requests.clear()
            assert sorted(run()) == first[:shown]
            asked = [x for x in web.requests if "head" not in x]
            if shown == 700:
                assert asked and not any("token=0&" in x or "token=150&" in x for x in asked)  # nothing is read twice
    web.shown.clear()


def test_posts_with_parents_and_windows(spark, web, events):
    reader = spark.read.format("posts").options(base=f"{web.url}/2", queries='["click", "none"]', windows="3", page_size="100")
    span = "created_at >= TIMESTAMP '2024-01-05 00:00:00Z' AND created_at < TIMESTAMP '2024-01-25 00:00:00Z'"
    posts = reader.load().where(span)
    assert posts.rdd.getNumPartitions() == 6 and reader.load().rdd.getNumPartitions() == 2
    held = {r.event_id: r for r in events.collect()}
    got = posts.collect()
    assert {int(r.id) for r in got} == {k for k, r in held.items() if r.event_type == "click" and 5 <= r.ts.day < 25} and len(got) == len({r.id for r in got})
    for r in got:
        k = int(r.id)
        parent = held[k // 2] if k % 3 else None
        assert r.username == f"user{held[k].user_id}" and r.replied_to == (str(k // 2) if parent else None)
        assert r.parent_text == (parent and f"{parent.event_type} {parent.event_id}") and r.parent_username == (parent and f"user{parent.user_id}")
    few = reader.option("most", "25").load()
    assert few.count() == 25


def test_posts_by_id_users_and_streams_of_posts(spark, web, events, tmp_path):
    base = {"base": f"{web.url}/2"}
    ids = [str(r.event_id) for r in events.orderBy("event_id").limit(230).collect()]
    posts = spark.read.format("posts").options(**base, kind="posts", queries=json.dumps(ids)).load()
    assert posts.rdd.getNumPartitions() == 3 and {r.id for r in posts.collect()} == set(ids)
    user = events.first().user_id
    names = json.dumps([f"user{user}"])
    timeline = spark.read.format("posts").options(**base, kind="timeline", queries=names).load()
    assert timeline.count() == events.where(F.col("user_id") == user).count()
    profile = spark.read.format("posts").options(**base, kind="profile", queries=names).load().collect()
    assert [(r.username, r.followers, r.posts) for r in profile] == [(f"user{user}", 2 * user, 1)]
    for shown in (400, 400, 1 << 60):
        web.shown["posts"] = shown
        stream = spark.readStream.format("posts").options(**base, queries='["click", "view"]', page_size="100").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/rows").awaitTermination()
        got = [int(r.id) for r in spark.read.parquet(f"{tmp_path}/rows").collect()]
        assert sorted(got) == sorted(r.event_id for r in events.where("event_type in ('click', 'view')").collect() if r.event_id < shown)
    web.shown.clear()
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("posts").options(**base, kind="other").load().count()


def test_flights_in_windows_and_states(spark, web, events):
    reader = spark.read.format("flights").options(base=web.url, queries='["departures:edcl", "icao24:00000A", "area:-10,-20,30,40"]')
    rows = reader.load().where("first_seen >= TIMESTAMP '2024-01-03 00:00:00Z' AND first_seen < TIMESTAMP '2024-01-12 00:00:00Z'")
    assert rows.rdd.getNumPartitions() == 5 + 1 + 5 + 1
    got = rows.where("kind = 'flight'").collect()
    inside = [r for r in events.collect() if 3 <= r.ts.day < 12]
    assert sorted((r["query"], r.callsign) for r in got) == sorted([("departures:edcl", f"F{r.event_id}") for r in inside if r.event_type == "click"] + [("icao24:00000A", f"F{r.event_id}") for r in inside if r.user_id == 10])
    assert all(r.departure[:2] == "ED" and r.last_seen > r.first_seen for r in got)
    states = reader.option("begin", "0").option("end", "1").load().where("kind = 'state' AND query LIKE 'area%'").collect()
    assert states and all(-10 <= r.latitude <= 30 and -20 <= r.longitude <= 40 for r in states)


def test_search_services_and_failures(spark, web):
    host = spark.read.parquet(f"{SF}/pages.parquet").where("page_id = 1").select(F.regexp_extract("url", r"://([^/?#]*)/", 1)).first()[0]
    for name in services.PROVIDERS:
        rows = spark.read.format("web_search").options(base=web.url, provider=name, queries=json.dumps([host, "nowhere"]), limit="3").load().collect()
        assert rows and all(r["query"] == host and r.error is None and r.url for r in rows) and [r.position for r in rows] == list(range(1, len(rows) + 1))
    web.failures["/search"] = 2  # is asked again
    assert spark.read.format("web_search").options(base=web.url, provider="searxng", queries=json.dumps([host]), pause="0.01").load().where("error is null").count() > 0
    web.failures["/search"] = 99
    rows = spark.read.format("web_search").options(base=web.url, provider="searxng", queries=json.dumps([host]), pause="0.01").load().collect()
    assert [r["query"] for r in rows] == [host] and "429" in rows[0].error
    web.failures.clear()


def test_an_error_ends_the_job_unless_the_schema_takes_it(spark, web):
    web.failures["/feed/events"] = 10_000
    options = {"url": f"{web.url}/feed/events", "rows": "rows", "queries": '["a"]', "pause": "0.001"}
    with pytest.raises(Exception, match="429"):
        spark.read.format("paged").schema(Q._EVENT).options(**options).load().count()
    rows = spark.read.format("paged").schema(f"{Q._EVENT}, query string, error string").options(**options).load().collect()
    assert [(r["query"], r.event_id) for r in rows] == [("a", None)] and "429" in rows[0].error
    web.failures.clear()


def test_values_take_the_column_s_type():
    from datetime import datetime, timezone

    from pyspark.sql.types import ArrayType, DateType, DoubleType, LongType, StringType, StructType, TimestampNTZType, TimestampType

    assert services.typed({"a": 1}, StringType()) == '{"a": 1}' and services.typed("x", LongType()) is None and services.typed("7", LongType()) == 7
    assert services.typed(1, DoubleType()) == 1.0 and services.typed("2024-01-02", DateType()).day == 2 and services.typed(None, LongType()) is None
    moment = datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert services.typed("2024-01-02T01:00:00+01:00", TimestampType()) == moment and services.typed(moment.timestamp(), TimestampNTZType()) == moment.replace(tzinfo=None)
    assert services.typed([{"a": "1"}], ArrayType(StructType().add("a", LongType()))) == [(1,)]
    assert services.at({"a": [{"b": 1}]}, "a.0.b") == 1 and services.at({"a": None}, "a.b") is None and services.at([1], "5") is None
