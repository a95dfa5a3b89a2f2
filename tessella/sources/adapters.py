"""Views of the generic star-schema tables as the tables of a panel experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each decision: six profiles in each (event, treatment, model) cell."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    div = lambda k: F.floor(n / k).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    code = lambda letter, v: F.concat(F.lit(letter), F.lpad(v.cast("string"), 3, "0"))
    return e.select(
        n.alias("row_number"),
        div(60).alias("item"),
        F.concat(F.lit("evt_"), div(60).cast("string")).alias("event_id"),
        F.element_at(F.array(*map(F.lit, ("T1", "B0", "T2", "T3", "T4"))), (div(6) % 5 + 1).cast("int")).alias("treatment_family"),
        F.concat(F.lit("m"), (div(30) % 2).cast("string")).alias("model_family"),
        F.concat(F.lit("p"), (n % 6).cast("string")).alias("profile"),
        F.when(n % 6 < 3, "retail").otherwise("institutional").alias("profile_group"),
        (((F.floor(F.col("value") * 100 + 0.5).cast("bigint") % 4001) - 2000).cast("double") / F.lit(10000.0)).alias("er"),
        ((F.floor(F.col("value") * 100 + 0.5).cast("bigint") % 101).cast("double") / F.lit(100.0)).alias("confidence"),
        F.when(F.col("event_type").isin("purchase", "signup"), "buy").when(F.col("event_type") == "error", "sell").otherwise("hold").alias("action"),
        k.alias("k"),
        F.sort_array(F.array_distinct(F.array(code("S", k % 7), code("S", F.floor(k / 7).cast("bigint") % 7), code("X", k % 3)))).alias("evidence"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden outcome of each item: item, car."""
    o = table(spark, sf_dir, "orders")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    return o.select(F.col("o_orderkey").alias("item"), ((cents % 401 - 200).cast("double") / F.lit(1000.0)).alias("car"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("item"), F.col("c_name").alias("ticker"), F.col("c_mktsegment").alias("sector"), F.when(F.col("c_acctbal") >= 5000, "large_cap").otherwise("small_mid_cap").alias("market_cap_group"))


def source_categories(spark: SparkSession) -> DataFrame:
    """Evidence categories of source ids; some ids have none."""
    rows = [(f"S00{i}", ("revenue", "guidance", "margins", "risk", "cash")[i]) for i in range(5)] + [(f"X00{i}", ("revenue", "earnings")[i]) for i in range(2)]
    return spark.createDataFrame(rows, "source_id string, category string")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price of each ticker: the mean value of a user's events, added up by event_id so that partitions do not change its last digit."""
    e = table(spark, sf_dir, "events")
    values = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value"))))
    days = e.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day")).agg(values.alias("v"))
    return days.select("ticker", "day", F.when(F.size("v") > 0, F.aggregate("v", F.lit(0.0), lambda a, s: a + s["value"]) / F.size("v")).alias("price"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean value of all events, added up by event_id like prices; the rows of a day pass one task in order and may spill."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "value")
    w = Window.partitionBy("day").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = e.select("day", F.struct(F.row_number().over(w).alias("at"), F.sum("value").over(w).alias("total"), F.count("value").over(w).alias("n")).alias("s"))
    return so_far.groupBy("day").agg(F.max("s").alias("s")).select("day", F.when(F.col("s.n") > 0, F.col("s.total") / F.col("s.n")).alias("price"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's announcement: its last event before 2024-01-25."""
    e = table(spark, sf_dir, "events").where("ts < timestamp'2024-01-25'")
    return e.groupBy(F.col("user_id").alias("ticker")).agg(F.max("ts").alias("accepted_at"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate events for selection: orders as filings of customers."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("issuer"), F.col("n_regionkey").alias("cap_group"), F.col("c_mktsegment").alias("sector"),
        F.col("o_orderdate").alias("accepted_at"), F.floor("o_totalprice").cast("bigint").alias("tokens"), F.col("o_orderstatus").alias("status"), F.col("c_acctbal").alias("balance"),
    )


__all__ = ["accepted", "decisions", "filings", "market", "metadata", "outcomes", "prices", "source_categories", "table"]
