"""What larger tables brought up: sides of joins that grow with the events, years of five digits."""

from pyspark.sql import functions as F

from tracelake.operators.ranges import range_lookup
from tracelake.plans import catalogue, oversize, procs

KEY = "evidence string, catalog_seq int, p1 long, p2 long"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimensions_never_pass_through_the_driver(spark):
    events = spark.createDataFrame([("a", 0, 1, 2, 1, 0x10, 4, 9)], f"{KEY}, subsystem_id int, address long, activity_type int, data_ref long").withColumn("items", F.array(F.lit(1)))
    people = spark.createDataFrame([("a", 0, 1, 2, 7, 8, "m", "d")], f"{KEY}, pid int, euid int, main_uuid string, dsc_uuid string")
    subsystems = spark.createDataFrame([("a", 0, 1, 2, 1, "s", "c")], f"{KEY}, subsystem_id int, subsystem string, category string")
    images = spark.createDataFrame([("a", 0, 1, 2, 0, 0, 64, "u")], f"{KEY}, at int, low long, size long, image_uuid string")
    large = spark.createDataFrame([("a", 0, 0, 9, 1, 2)], "evidence string, catalog_seq int, chunk_seq int, data_ref long, p1 long, p2 long").withColumn("items", F.array(F.lit(5)))
    joined = [procs.with_process(events, people), procs.with_subsystem(events, subsystems), range_lookup(events, images, procs.KEY, "address"), oversize.with_oversize(events, large)]
    for df in joined:
        assert "Broadcast" not in final_plan(df)
    assert [joined[0].first().pid, joined[1].first().subsystem, joined[2].first().image_uuid, joined[3].first().message_items] == [7, "s", "u", [5]]


def test_archives_broadcast_no_processes(spark):
    from tracelake.plans.queries_messages import archive_events

    e = spark.createDataFrame([(n, n % 5, 1.0, "view") for n in range(40)], "event_id long, user_id long, value double, event_type string")
    df = archive_events(e).where("section = 0").select("pid", "subsystem", "message")
    plan = final_plan(df)
    assert plan.count("SortMergeJoin") >= 4 and df.count() == 40


def test_years_after_9999(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(n,) for n in (0, 2_930_000, 2_940_000, 5_999_999, 35_999_999)], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.iso for r in catalogue.QUERIES["q_iso_ms"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == dict(con.execute(catalogue.ORACLES["q_iso_ms"]).fetchall())
    assert got[5_999_999][:2] != "+1" and len(got[5_999_999]) == 25
