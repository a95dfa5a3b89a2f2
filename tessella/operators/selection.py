"""Eligibility and stratified selection of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligibility_reasons(rules: dict[str, Column]) -> Column:
    """All failing rules, joined by semicolons; a null condition fails."""
    return F.array_join(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull()), ";")


def one_per_issuer(filings: DataFrame) -> DataFrame:
    """The latest filing of each issuer in a group; ties by tokens, balance, then accession."""
    w = Window.partitionBy("cap_group", "issuer").orderBy(F.desc_nulls_last("accepted_at"), F.desc_nulls_last("tokens"), F.desc_nulls_last(F.abs("balance")), F.asc("accession"))
    return filings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def balanced_targets(available: dict, wanted: int, common: bool = True) -> dict:
    """Rows to take from each group: at most what is wanted and there, and alike for all if ``common``."""
    out = {g: min(wanted, n) for g, n in available.items()}
    return {g: min(out.values()) for g in out} if common and out else out


def top_of_group(filings: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("cap_group").orderBy("sector", F.desc("accepted_at"), F.desc("tokens"), F.desc(F.abs("balance")), "accession")
    return filings.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def _spread(filings: DataFrame, group: str, within: list[Column], order: list[Column], n: int, quota) -> DataFrame:
    """First up to ``quota`` rows of each part in the group's order, then the group's next rows until n are there."""
    w, part = Window.partitionBy(group), Window.partitionBy(group, *within)
    x = filings.withColumn("_r", F.row_number().over(part.orderBy(*order)))
    x = x.withColumn("_q", quota(part, w)).withColumn("_late", (F.col("_r") > F.col("_q")).cast("int"))
    return x.withColumn("pick", F.row_number().over(w.orderBy("_late", *order))).where(F.col("pick") <= n).drop("_r", "_q", "_late")


def diverse(filings: DataFrame, n: int) -> DataFrame:
    """At most ceil(n / issuers) filings of one issuer, filled up from the rest in order."""
    order = [F.desc("accepted_at"), F.asc("accession")]
    issuers = filings.groupBy("cap_group").agg(F.count_distinct("issuer").alias("_i"))
    return _spread(filings.join(issuers, "cap_group"), "cap_group", [F.col("issuer")], order, n, lambda part, w: F.greatest(F.lit(1), F.ceil(F.lit(float(n)) / F.col("_i")))).drop("_i")


def time_balanced(filings: DataFrame, n: int) -> DataFrame:
    """n // years filings of each year, then the latest others."""
    order = [F.desc("accepted_at"), F.asc("accession")]
    x = filings.withColumn("year", F.year("accepted_at"))
    years = x.groupBy("cap_group").agg(F.count_distinct("year").alias("_y"))
    return _spread(x.join(years, "cap_group"), "cap_group", [F.col("year")], order, n, lambda part, w: F.floor(F.lit(float(n)) / F.col("_y"))).drop("_y")


def sector_balanced(filings: DataFrame, n: int) -> DataFrame:
    """n // sectors of each sector, the remainder to the first sectors by name, then the latest others."""
    order = [F.desc("accepted_at"), F.asc("accession")]
    s = filings.select("cap_group", "sector").distinct()
    s = s.withColumn("_k", F.row_number().over(Window.partitionBy("cap_group").orderBy("sector"))).withColumn("_s", F.count("*").over(Window.partitionBy("cap_group")))
    quota = lambda part, w: F.floor(F.lit(float(n)) / F.col("_s")) + F.when(F.col("_k") <= F.lit(n) % F.col("_s"), 1).otherwise(0)
    return _spread(filings.join(s, ["cap_group", "sector"]), "cap_group", [F.col("sector")], order, n, quota).drop("_k", "_s")


def best_join_key(left: DataFrame, right: DataFrame, candidates: list[list[str]]) -> list[str] | None:
    """Of the candidate keys that both sides have, the one with most common distinct values; the first of equals."""
    scored = [(left.select(*k).distinct().intersect(right.select(*k).distinct()).count(), -i) for i, k in enumerate(candidates) if set(k) <= set(left.columns) & set(right.columns) for k in [k]]
    best = max(scored, default=(0, 0))
    return candidates[-best[1]] if best[0] else None


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
