"""What the queries over the driver's tables derive from them, in Spark and in SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG_CODES = {"click": 0, "view": 1, "signup": 2, "error": 16, "purchase": 17}
KINDS = [4, 2, 6, 3, 7]
EPOCH = 1_704_067_200_000_000  # 2024-01-01 in microseconds
PER_BOOT = 2500


def query(name: str, sql: str | None = None):
    """Registers a query, with the SQL of its oracle if there is one."""

    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_case(code: str, values: dict, default: str) -> str:
    """A CASE over a code for the texts of a table; default is SQL."""
    return f"CASE {code} " + " ".join(f"WHEN {quoted(k) if isinstance(k, str) else k} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {default} END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with lt (log code), kind, p1, boot and t (microseconds since 2024)."""
    e = table(spark, sf_dir, "events")
    code = F.create_map(*[F.lit(x) for k, v in LOG_CODES.items() for x in (k, v)])
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.withColumns({
        "lt": F.element_at(code, F.col("event_type")), "kind": kind, "p1": F.col("user_id"), "boot": F.floor(F.col("event_id") / PER_BOOT).cast("bigint"),
        "t": F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH,
    })


EV = f"""ev AS (
  SELECT event_id, ts, user_id, event_type, value, props, {sql_case("event_type", LOG_CODES, "NULL")} AS lt, {KINDS}[event_id % 5 + 1] AS kind,
         user_id AS p1, event_id // {PER_BOOT} AS boot, epoch_us(ts) - {EPOCH} AS t
  FROM events
)"""


def code_query(name: str, code: str, columns: dict[str, tuple[Callable[[Column], Column], str]]) -> None:
    """Registers a query of column functions over a code computed from event_id; columns: (function, SQL of the same)."""

    @query(name, f"WITH c AS (SELECT event_id, {code} AS code FROM events) SELECT event_id, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + " FROM c")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select("event_id", F.expr(code.replace("//", "div")).alias("code"))
        return rows.select("event_id", *[f(F.col("code")).alias(c) for c, (f, _) in columns.items()])
