"""The versions that the catalog's queries compare, and the same in SQL.

Keys are order keys; prices are whole cents, so both engines print and add them alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.model import TableSpec

#: The inserted keys of v2, ours and theirs meet others where there are over a million orders.
ORDERS = TableSpec(("key",), ("status", "cents"), repeats=True)
USERS = TableSpec(("user_id",), ("value",))

BASE_SQL = "SELECT o_orderkey AS key, o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"
V2_SQL = f"""SELECT key, status, CASE WHEN key % 31 = 0 THEN cents + 100 ELSE cents END AS cents FROM ({BASE_SQL}) WHERE key % 97 <> 0
UNION ALL SELECT key + 1000000, status, cents FROM ({BASE_SQL}) WHERE key % 101 = 0"""
OURS_SQL = f"""SELECT key, status, CASE WHEN key % 60 = 0 THEN cents + 500 WHEN key % 6 = 0 THEN cents + 100 ELSE cents END AS cents FROM ({BASE_SQL}) WHERE key % 7 <> 0
UNION ALL SELECT key + 2000000, status, CASE WHEN key % 300 = 0 THEN cents ELSE cents + 1000 END FROM ({BASE_SQL}) WHERE key % 50 = 0"""
THEIRS_SQL = f"""SELECT key, status, CASE WHEN key % 60 = 0 THEN cents + 500 WHEN key % 10 = 0 THEN cents + 200 ELSE cents END AS cents FROM ({BASE_SQL}) WHERE key % 11 <> 0
UNION ALL SELECT key + 2000000, status, CASE WHEN key % 300 = 0 THEN cents ELSE cents + 2000 END FROM ({BASE_SQL}) WHERE key % 75 = 0"""
LOG_SQL = """SELECT user_id, CAST(round(value * 100) AS BIGINT) AS value, event_type = 'error' AS is_delete, event_id AS seq,
  CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events"""

#: Commits made from events: one for each day and event type.  Its first parent is the type's commit of the day before; on every
#: third day the next type's commit of the day before is merged in.  So lines run beside each other and cross again and again.
DAG_SQL = """WITH c AS (SELECT DISTINCT event_type AS t, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events),
  ty AS (SELECT t, coalesce(lead(t) OVER (ORDER BY t), min(t) OVER ()) AS u FROM (SELECT DISTINCT t FROM c))
  SELECT c.t AS kind, c.day AS day, c.t || '-' || c.day AS commit_id, list_filter([a.t || '-' || a.day, b.t || '-' || b.day], lambda x: x IS NOT NULL) AS parents,
    CAST(c.day AS BIGINT) AS ts, 'r' || c.t || c.day AS root
  FROM c JOIN ty ON ty.t = c.t LEFT JOIN c a ON a.t = c.t AND a.day = c.day - 1 LEFT JOIN c b ON b.t = ty.u AND b.t <> c.t AND b.day = c.day - 1 AND c.day % 3 = 0"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def _more(step: int):
    return F.col("key") % step == 0


def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    kept = b.where(~_more(97)).withColumn("cents", F.when(_more(31), F.col("cents") + 100).otherwise(F.col("cents")))
    return kept.unionByName(b.where(_more(101)).withColumn("key", F.col("key") + 1_000_000))


def _side(b: DataFrame, gone: int, edit: int, by: int, insert: int, plus: int) -> DataFrame:
    cents = F.when(_more(60), F.col("cents") + 500).when(_more(edit), F.col("cents") + by).otherwise(F.col("cents"))
    added = b.where(_more(insert)).withColumn("cents", F.when(_more(300), F.col("cents")).otherwise(F.col("cents") + plus))
    return b.where(~_more(gone)).withColumn("cents", cents).unionByName(added.withColumn("key", F.col("key") + 2_000_000))


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(base(spark, sf_dir), 7, 6, 100, 50, 1000)


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side(base(spark, sf_dir), 11, 10, 200, 75, 2000)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of users' values: an ``error`` event deletes.  A version is a calendar day."""
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(events: DataFrame) -> DataFrame:
    """The edits that events, from a table or a stream, stand for."""
    return events.select(
        "user_id",
        F.round(F.col("value") * 100).cast("long").alias("value"),
        (F.col("event_type") == "error").alias("is_delete"),
        F.col("event_id").alias("seq"),
        F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
    )


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log_days(spark, sf_dir)
    order = Window.orderBy("t")  # a row for each event type
    types = c.select("t").distinct().withColumn("u", F.coalesce(F.lead("t").over(order), F.min("t").over(Window.partitionBy())))

    def name(t: str, day: str):
        return F.concat(F.col(t), F.lit("-"), F.col(day))

    a = c.select(F.col("t").alias("at"), F.col("day").alias("aday"))
    b = c.select(F.col("t").alias("bt"), F.col("day").alias("bday"))
    out = c.join(types, "t").join(a, (F.col("at") == F.col("t")) & (F.col("aday") == F.col("day") - 1), "left")
    out = out.join(b, (F.col("bt") == F.col("u")) & (F.col("bt") != F.col("t")) & (F.col("bday") == F.col("day") - 1) & (F.col("day") % 3 == 0), "left")
    parents = F.filter(F.array(name("at", "aday"), name("bt", "bday")), lambda x: x.isNotNull())
    return out.select(F.col("t").alias("kind"), "day", name("t", "day").alias("commit_id"), parents.alias("parents"), F.col("day").cast("long").alias("ts"), F.concat(F.lit("r"), "t", "day").alias("root"))


def log_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("t"), F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).distinct()


def heads(dag: DataFrame) -> tuple[str, str]:
    """The last commits of the first and of the last event type."""
    last = sorted(tuple(r) for r in dag.groupBy("kind").agg(F.max_by("commit_id", "day")).collect())
    return last[0][1], last[-1][1]
