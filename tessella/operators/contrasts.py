"""Paired contrasts between treatment families, transitions and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import expr as X

METRICS = ["er_sd", "belief_mad", "action_entropy", "net_direction"]
KEY = ["event_id", "model_family", "investor_group"]
#: Contrast, baseline, comparison, denominator family, index type.
CONTRASTS = [("T3_minus_T2", "T2", "T3", "T3", "SCI"), ("T4_minus_T2", "T2", "T4", "T3", "SEMI"), *[(f"{c}_minus_T1", "T1", c, None, "raw_delta") for c in ("B0", "T2", "T3", "T4")], *[(f"{c}_minus_B0", "B0", c, None, "raw_delta") for c in ("T2", "T3", "T4")]]


def _r(c, name):
    return F.round(c, 6).alias(name)


def unique_rows(cells: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once; others pair with nothing."""
    return cells.join(cells.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n"), key, "left_semi")


def contrasts_wide(cells: DataFrame, near_zero: float = 1e-6) -> DataFrame:
    """T3 minus T2 of every metric in one aggregation; the index is null where T3 is below the limit."""
    fam = lambda f, m: F.max(F.when(F.col("treatment_family") == f, F.col(m)))
    g = cells.where("treatment_family in ('T2', 'T3')").groupBy(*KEY).agg(F.count_if(F.col("treatment_family") == "T2").alias("n2"), F.count_if(F.col("treatment_family") == "T3").alias("n3"), *[fam(f, m).alias(f"{m}_{f}") for m in METRICS for f in ("T2", "T3")]).where("n2 = 1 and n3 = 1")
    out = []
    for m in METRICS:
        d = F.col(f"{m}_T3") - F.col(f"{m}_T2")
        out += [F.col(f"{m}_T2"), F.col(f"{m}_T3"), _r(d, f"{m}_delta"), _r(F.when(F.col(f"{m}_T3") >= near_zero, d / F.col(f"{m}_T3")), f"{m}_sci")]
    return g.select(*KEY, *out)


def contrasts_long(cells: DataFrame, near_zero: float = 1e-6) -> DataFrame:
    """Every declared contrast, one row for each metric; families become columns once, so one shuffle serves all."""
    cells = unique_rows(cells, [*KEY, "treatment_family"])
    long = cells.select(*KEY, "treatment_family", F.expr("stack({}, {}) as (metric, value)".format(len(METRICS), ", ".join(f"'{m}', {m}" for m in METRICS))))
    fams = sorted({f for _, b, c, d, _ in CONTRASTS for f in (b, c, d) if f})
    wide = long.groupBy(*KEY, "metric").agg(*[F.max(F.when(F.col("treatment_family") == f, F.col("value"))).alias(f) for f in fams], *[F.count_if(F.col("treatment_family") == f).alias(f"n_{f}") for f in fams])
    rows = F.array(*[F.struct(F.lit(n).alias("contrast"), F.lit(kind).alias("index_type"), F.col(b).alias("baseline"), F.col(c).alias("comparison"), (F.col(d) if d else F.lit(None).cast("double")).alias("denominator"), ((F.col(f"n_{b}") > 0) & (F.col(f"n_{c}") > 0)).alias("ok")) for n, b, c, d, kind in CONTRASTS])
    x = wide.select(*KEY, "metric", F.inline(rows)).where("ok")
    delta = F.col("comparison") - F.col("baseline")
    stable = F.when(F.col("index_type") == "raw_delta", F.lit(None).cast("boolean")).otherwise(F.coalesce(F.abs("denominator") >= near_zero, F.lit(False)))
    return x.select(*KEY, "metric", "contrast", "index_type", "baseline", "comparison", _r(delta, "delta"), stable.alias("stable"), _r(F.when(stable, delta / F.col("denominator")), "index_value"))


def treatment_means(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy("treatment_family", *keys).agg(F.count("*").alias("n_cells"), *[_r(F.avg(m), m) for m in METRICS])


def contrast_means(long: DataFrame) -> DataFrame:
    return long.where("investor_group = 'all_profiles'").groupBy("contrast").pivot("metric", METRICS).agg(F.round(F.avg("delta"), 6))


def transitions(decisions: DataFrame, baseline: str, comparison: str) -> DataFrame:
    """Paired actions of the same profile under two treatments."""
    key = ["event_id", "model_family", "profile"]
    side = lambda f, n: decisions.where(F.col("treatment_family") == f).select(*key, F.col("action").alias(n))
    return side(baseline, "before").join(side(comparison, "after"), key)


def transition_summary(pairs: DataFrame) -> DataFrame:
    """Shares of each change, overall and by profile, with grouping sets."""
    share = lambda cond, n: _r(F.avg(F.expr(cond).cast("double")), n)
    return pairs.rollup("profile").agg(
        F.count("*").alias("n"), share("before = after", "same"), share("before <> after", "changed"), share("before = 'buy' and after = 'hold'", "buy_to_hold"), share("before = 'sell' and after = 'hold'", "sell_to_hold"),
        share("before = 'hold' and after <> 'hold'", "hold_to_trade"), share("(before = 'buy' and after = 'sell') or (before = 'sell' and after = 'buy')", "flip"),
    ).withColumn("profile", F.coalesce("profile", F.lit("all")))


def profile_behaviour(rows: DataFrame) -> DataFrame:
    return rows.groupBy("treatment_family", "profile").agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("n_events"), *[_r(F.avg((F.col("action") == a).cast("double")), f"share_{a}") for a in ("buy", "hold", "sell")], _r(F.avg("er"), "mean_er"), _r(F.avg("confidence"), "mean_confidence"), _r(F.avg("directional_accuracy"), "directional_accuracy"),
    )


def profile_contrasts(behaviour: DataFrame, baseline: str = "T1") -> DataFrame:
    b = behaviour.where(F.col("treatment_family") == baseline)
    cols = ["share_buy", "share_hold", "share_sell", "mean_er"]
    b = b.select("profile", *[F.col(c).alias(f"b_{c}") for c in cols])
    return behaviour.where(F.col("treatment_family") != baseline).join(b, "profile").select("profile", F.concat("treatment_family", F.lit(f"_minus_{baseline}")).alias("contrast"), *[_r(F.col(c) - F.col(f"b_{c}"), c) for c in cols])


def side_by_side(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison of two bundles of means."""
    a, b = (x.select(*key, *[F.col(v).alias(f"{v}_{n}") for v in values]) for x, n in ((old, "old"), (new, "new")))
    return a.join(b, key, "full").select(*key, *[c for v in values for c in (F.col(f"{v}_old"), F.col(f"{v}_new"), _r(F.col(f"{v}_new") - F.col(f"{v}_old"), f"{v}_delta"))])


def source_uptake(decisions: DataFrame) -> DataFrame:
    n = F.size("evidence")
    d = decisions.select("treatment_family", "event_id", n.alias("n"), "evidence")
    u = d.select("treatment_family", F.explode("evidence").alias("s")).groupBy("treatment_family").agg(F.count_distinct("s").alias("distinct_sources"))
    ev = d.groupBy("treatment_family", "event_id").agg(F.avg("n").alias("m")).groupBy("treatment_family").agg(F.avg("m").alias("em"))
    return d.groupBy("treatment_family").agg(_r(F.avg("n"), "mean_sources"), F.median("n").alias("median_sources")).join(u, "treatment_family").join(ev, "treatment_family").select("treatment_family", "mean_sources", "median_sources", "distinct_sources", _r("em", "event_mean_sources"))


def positive_share(decisions: DataFrame) -> DataFrame:
    """Share of strictly positive expectations and mean by event and family; a null is not positive."""
    return decisions.groupBy("event_id", "treatment_family").agg(_r(F.avg(F.coalesce((F.col("er") > 0).cast("double"), F.lit(0.0))), "p_plus"), _r(F.avg("er"), "mean_er"), _r(F.avg((F.col("action") == "buy").cast("double")), "buy_rate"))


def separability(decisions: DataFrame) -> DataFrame:
    """Mean paired difference in expectation of each profile pair, by treatment."""
    key = ["event_id", "treatment_family", "model_family"]
    a, b = (decisions.select(*key, F.col("profile").alias(p), F.col("er").alias(e)) for p, e in (("p", "x"), ("q", "y")))
    return a.join(b, key).where("p < q").groupBy("treatment_family", "p", "q").agg(F.count("*").alias("n"), _r(F.avg(F.col("y") - F.col("x")), "delta"))


def conditional_positive(rows: DataFrame) -> DataFrame:
    """Positive-prediction rate by realised sign, by treatment and pooled; the sign is exact."""
    sign = F.when(F.col("car") > 0, "positive").when(F.col("car") < 0, "negative").otherwise("zero")
    x = rows.where("car is not null").withColumn("outcome", sign).withColumn("treatment", F.explode(F.array("treatment_family", F.lit("pooled"))))
    return x.groupBy("treatment", "outcome").agg(F.count("*").alias("n"), _r(F.avg((F.col("er") > 0).cast("double")), "positive_rate"))


def group_summary(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[c for v in values for c in (_r(F.avg(v), f"{v}_mean"), _r(F.median(v), f"{v}_median"), _r(F.avg((F.col(v) > 0).cast("double")), f"{v}_positive"))])


def decision_codes(decisions: DataFrame) -> DataFrame:
    return decisions.select("row_number", X.action_code(F.col("action")).alias("code"), X.epsilon_sign(F.col("er")).alias("er_sign"), X.family_of(F.concat("treatment_family", F.lit("_x"))).alias("family"))
