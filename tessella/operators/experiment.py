"""Cells, contrasts, inference and readouts over the full key of a decision: event, upstream, model, seeds and treatment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import expr as X
from tessella.operators.inference import benjamini_hochberg, replicate_means

PAIR = ["event_id", "upstream_model_family", "model_family", "representation_seed", "decision_seed"]
CELL = [*PAIR, "treatment", "treatment_family"]
#: Profiles of a complete group.
EXPECTED = {
    "all_profiles": ("day_trader", "swing_trader", "long_term_retail", "event_driven_hedge_fund", "prop_trading", "investment_advisor"),
    "retail": ("day_trader", "swing_trader", "long_term_retail"),
    "institutional": ("event_driven_hedge_fund", "prop_trading", "investment_advisor"),
    "unprofiled": ("unprofiled_baseline",),
}
#: Metrics that are contrasted.
CONTRASTED = ["std_expected_return_5d", "belief_mad", "iqr_expected_return_5d", "confidence_dispersion", "action_entropy", "action_simpson", "direction_diversity", "source_diversity", "category_diversity"]
#: Contrast, baseline, comparison, denominator, index; the first two pair on all of PAIR, the others on event, model and decision seed.
PAIRED = [("T3_minus_T2", "T2", "T3", "T3", "SCI"), ("T4_minus_T2", "T2", "T4", "T3", "SEMI")]
REPEATED = [*[(f"{c}_minus_T1", "T1", c) for c in ("B0", "T2", "T3", "T4")], *[(f"{c}_minus_B0", "B0", c) for c in ("T2", "T3", "T4")]]
TREATMENT_ORDER = ["T1", "B0", "T2", "T3", "T4", "T5", "T6"]
GROUP_ORDER = ["all_profiles", "retail", "institutional", "unprofiled"]


def _r(c, name):
    return F.round(c, 6).alias(name)


def _action_counts() -> dict[str, Column]:
    return {a: F.count_if(F.col("action") == a) for a in ("buy", "hold", "sell")}


def cells(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, warnings): every metric of each cell and investor group in one aggregation.

    ``all_profiles`` holds every row, also those without a known profile. A
    cell in which a profile occurs twice is left out and becomes a warning
    with the profile. Category metrics need a category set of every member and
    some coverage; ``categories`` and ``coverage`` are optional columns.
    """
    have = {"categories": "array<string>", "coverage": "double", "car": "double"}
    rows = decisions.withColumns({c: F.lit(None).cast(k) for c, k in have.items() if c not in decisions.columns})
    twice = F.count("*").over(Window.partitionBy(*CELL, "profile_canonical"))
    worst = F.max("twice").over(Window.partitionBy(*CELL))
    rows = rows.withColumn("twice", twice).withColumn("worst", worst)
    warnings = rows.where("twice > 1").groupBy(*CELL).agg(F.array_join(F.array_sort(F.collect_set("profile_canonical")), ",").alias("profiles"))
    r = rows.where("worst = 1").withColumn("investor_group", F.explode(F.array_distinct(F.array(F.lit("all_profiles"), "profile_group"))))
    n, c = F.count("*"), _action_counts()
    real = X.epsilon_sign(F.col("car"))
    sets = lambda column, empty: X.mean_over_pairs(F.collect_list(column), lambda a, b: X.jaccard(a, b, empty))
    g = r.groupBy(*CELL, "investor_group").agg(
        n.alias("profile_count"), F.array_sort(F.collect_set("profile_canonical")).alias("profiles"),
        F.stddev_pop("expected_return_5d").alias("std_expected_return_5d"), F.collect_list("expected_return_5d").alias("ers"), (F.percentile("expected_return_5d", F.lit(0.75)) - F.percentile("expected_return_5d", F.lit(0.25))).alias("iqr_expected_return_5d"),
        F.stddev_pop("confidence").alias("confidence_dispersion"), X.entropy_bits(list(c.values()), n).alias("action_entropy"), X.concentration(list(c.values()), n).alias("action_hhi"), F.abs(F.avg("action_code")).alias("net_direction"),
        sets("evidence_used", 1.0).alias("source_overlap"), F.bool_and(F.col("categories").isNotNull()).alias("all_have"), F.avg("coverage").alias("coverage"), F.collect_list("categories").alias("category_sets"),
        F.first("car").alias("car"), F.avg((X.epsilon_sign(F.col("expected_return_5d")) == real).cast("double")).alias("directional_accuracy"), F.avg((F.col("action_code") == real).cast("double")).alias("action_accuracy"),
        F.avg(F.col("expected_return_5d") - F.col("car")).alias("signed_error"), F.avg(F.abs(F.col("expected_return_5d") - F.col("car"))).alias("absolute_error"),
    )
    expected = F.element_at(F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("investor_group"))
    missing = F.array_except(expected, F.col("profiles"))
    overlap = F.when(F.col("all_have") & (F.coalesce("coverage", F.lit(0.0)) > 0), X.mean_over_pairs(F.col("category_sets"), lambda a, b: X.jaccard(a, b, 1.0)))
    out = g.select(
        *CELL, "investor_group", "profile_count", ((F.col("profile_count") == F.size(expected)) & (F.size(missing) == 0)).alias("is_complete_group"), F.to_json(F.array_sort(missing)).alias("missing_profiles"), F.expr("profile_count * (profile_count - 1) div 2").alias("pair_count"),
        "std_expected_return_5d", X.mean_abs_difference(F.col("ers")).alias("belief_mad"), "iqr_expected_return_5d", "confidence_dispersion", "action_entropy", "action_hhi", (1 - F.col("action_hhi")).alias("action_simpson"), "net_direction", (1 - F.col("net_direction")).alias("direction_diversity"),
        "source_overlap", (1 - F.col("source_overlap")).alias("source_diversity"), overlap.alias("category_overlap"), (1 - overlap).alias("category_diversity"), "coverage", "car", "directional_accuracy", "action_accuracy", "signed_error", "absolute_error",
    )
    return out, warnings


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c) if c in keys or kinds[c] != "double" else _r(F.col(c), c) for c in df.columns])


def contrasts(cell_rows: DataFrame, near_zero: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(long contrasts, warnings), one row for each metric of a pair.

    T3 and T4 minus T2 pair on the whole key and are divided by T3 where that
    is not near zero. T1 and B0 have no upstream and one seed: their row is
    repeated for every comparison row of the event, model, group and decision
    seed. A baseline or denominator that is not unique is a warning and pairs
    with nothing.
    """
    key6, key4 = [*PAIR, "investor_group"], ["event_id", "model_family", "investor_group", "decision_seed"]
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in CONTRASTED])
    c = cell_rows.select(*key6, "treatment_family", metrics.alias("m"))
    family = lambda f: F.col("treatment_family") == f
    # one shuffle by the short key serves both keys: every row sees its partners through windows
    for n, key, families in ((6, key6, ("T2", "T3", "T4")), (4, key4, ("T1", "B0"))):
        w = Window.partitionBy(*key)
        c = c.withColumns({f"n{n}_{f}": F.count_if(family(f)).over(w) for f in families} | {f"m{n}_{f}": F.max(F.when(family(f), F.col("m"))).over(w) for f in families})
    none = F.lit(None).cast(c.schema["m"].dataType)
    row = lambda name, kind, base, den: F.struct(F.lit(name).alias("contrast"), F.lit(kind).alias("index_type"), base.alias("base"), den.alias("den"))
    found = [F.when(family(comp) & (F.col(f"n6_{comp}") == 1) & (F.col(f"n6_{base}") == 1), row(name, kind, F.col(f"m6_{base}"), F.when(F.col(f"n6_{den}") == 1, F.col(f"m6_{den}")))) for name, base, comp, den, kind in PAIRED]
    found += [F.when(family(comp) & (F.col(f"n4_{base}") == 1), row(name, "raw_delta", F.col(f"m4_{base}"), none)) for name, base, comp in REPEATED]
    x = c.withColumn("x", F.explode(F.filter(F.array(*found), lambda r: r.isNotNull()))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(CONTRASTED) - 1))))
    at = lambda column: column[F.col("i")]["v"]
    x = x.select(*key6, "x.contrast", "x.index_type", F.col("m")[F.col("i")]["metric"].alias("metric"), at(F.col("x.base")).alias("baseline"), at(F.col("m")).alias("comparison"), at(F.col("x.den")).alias("denominator"))
    delta = F.col("comparison") - F.col("baseline")
    stable = F.when(delta.isNull(), False).when(F.col("index_type") == "raw_delta", True).otherwise(F.coalesce(F.abs("denominator") >= near_zero, F.lit(False)))
    out = x.withColumn("delta", delta).withColumn("is_stable", stable).withColumn("normalized_index", F.when((F.col("index_type") != "raw_delta") & stable, delta / F.col("denominator")))
    many = lambda key, families: cell_rows.where(F.col("treatment_family").isin(*families)).groupBy(*key, "treatment_family").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", *key).alias("key"), F.col("treatment_family").alias("family"))
    return out, many(key6, ("T2", "T3", "T4")).unionByName(many(key4, ("T1", "B0")))


def wide_contrasts(cell_rows: DataFrame, near_zero: float = 1e-6) -> DataFrame:
    """T3 minus T2 in columns; the index is null where T3 is below the limit (not its absolute value)."""
    key6 = [*PAIR, "investor_group"]
    fam = lambda f, m: F.max(F.when(F.col("treatment_family") == f, F.col(m)))
    g = cell_rows.where("treatment_family in ('T2', 'T3')").groupBy(*key6).agg(F.count_if(F.col("treatment_family") == "T2").alias("n2"), F.count_if(F.col("treatment_family") == "T3").alias("n3"), *[fam(f, m).alias(f"{m}_{f}") for m in CONTRASTED for f in ("T2", "T3")]).where("n2 = 1 and n3 = 1")
    out = []
    for m in CONTRASTED:
        d = F.col(f"{m}_T3") - F.col(f"{m}_T2")
        out += [d.alias(f"{m}_delta"), F.when(F.col(f"{m}_T3") >= near_zero, d / F.col(f"{m}_T3")).alias(f"{m}_sci")]
    return g.select(*key6, *out)


# -- actions --------------------------------------------------------------------------------------

ACTION_METRICS = ["action_entropy", "action_hhi", "same_share", "net_direction", "trade_rate", "hold_share"]
#: Metrics that action_contrasts tests: all nine of the reports.
TESTED_METRICS = ["action_entropy", "entropy_normalized", "action_hhi", "action_simpson", "same_share", "action_diversity", "trade_rate", "hold_share", "net_direction"]


def sample_of(event: Column, high_risk: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with their sample: high_risk16 for the events of a table, else non_high_risk."""
    flagged = high_risk.select(event.alias("event_id")).distinct().withColumn("flag", F.lit(True))
    return rows.join(flagged, "event_id", "left").withColumn("sample", F.when(F.col("flag"), "high_risk16").otherwise("non_high_risk")).drop("flag")


def with_full_sample(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sample", F.explode(F.array(F.lit("full"), "sample")))


def loose_action_code(action: Column) -> Column:
    """-1, 0, 1; 0 for anything else."""
    return F.coalesce(X.action_code(F.lower(action)), F.lit(0))


def action_cells(decisions: DataFrame) -> DataFrame:
    """Action metrics of each cell and group; all_profiles holds retail and institutional rows only."""
    r = decisions.withColumn("investor_group", F.explode(X.groups_of(F.col("profile_group"), known_only=True))).where("investor_group in ('all_profiles', 'retail', 'institutional')")
    n, c = F.count("*"), _action_counts()
    pairs = reduce(lambda a, b: a + b, [v * (v - 1) / 2 for v in c.values()])
    entropy, hhi, net = X.entropy_bits(list(c.values()), n), X.concentration(list(c.values()), n), F.abs(F.avg(loose_action_code(F.col("action"))))
    same = F.when(n > 1, pairs / (n * (n - 1) / 2))
    keep = [k for k in ("sample",) if k in decisions.columns]
    return r.groupBy(*CELL, *keep, "investor_group").agg(
        n.alias("profile_count"), *[v.alias(f"{a}_count") for a, v in c.items()], *[(v / n).alias(f"{a}_share") for a, v in c.items()], ((c["buy"] + c["sell"]) / n).alias("trade_rate"),
        entropy.alias("action_entropy"), (entropy / F.log2(F.lit(3.0))).alias("entropy_normalized"), hhi.alias("action_hhi"), (1 - hhi).alias("action_simpson"), same.alias("same_share"), (1 - same).alias("action_diversity"),
        net.alias("net_direction"), (1 - net).alias("direction_diversity"), F.avg("action_strength").alias("mean_strength"), F.avg("confidence").alias("mean_confidence"),
    )


def action_means(cells_: DataFrame) -> DataFrame:
    """Means of every action metric by sample, treatment and group, in the reports' order."""
    out = with_full_sample(cells_).groupBy("sample", "treatment_family", "investor_group").agg(F.count("*").alias("n_cells"), F.count_distinct("event_id").alias("n_events"), *[F.round(F.avg(m), 7).alias(m) for m in (*ACTION_METRICS, "mean_strength", "mean_confidence")])
    return in_order(out, "investor_group", GROUP_ORDER, "treatment_family", TREATMENT_ORDER)


def in_order(rows: DataFrame, *columns_and_orders) -> DataFrame:
    """Rows sorted by the place of each column's value in its list; values that are not listed come last."""
    keys = []
    for column, order in zip(columns_and_orders[::2], columns_and_orders[1::2]):
        at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
        keys.append(F.when(at == 0, len(order) + 1).otherwise(at))
    return rows.orderBy(*keys)


def grouped_bootstrap(values: DataFrame, by: list[str], reps: int = 5000, value: str = "delta") -> DataFrame:
    """Event bootstrap of the mean for many tests at once: mean, median, positive share, interval and p by md5 draws.

    ``values`` has one row for each test and event. The draw of a replicate's
    slot depends on the two numbers only, so tests of one size share draws.
    """
    clean = values.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(value, F.round(value, 12))
    test = F.struct(*by)
    v = clean.select(test.alias("test"), F.col(value).alias("x"))
    means = replicate_means(clean, by, value, reps).select(test.alias("test"), F.round("mu", 12).alias("mu"))
    tail = F.least(F.avg((F.col("mu") <= 0).cast("double")), F.avg((F.col("mu") >= 0).cast("double")))
    ci = means.groupBy("test").agg(F.percentile("mu", F.lit(0.025)).alias("ci_low"), F.percentile("mu", F.lit(0.975)).alias("ci_high"), F.least(F.lit(1.0), 2 * tail).alias("p_value"))
    point = v.groupBy("test").agg(F.count("*").alias("n_events"), F.avg("x").alias("mean_delta"), F.median("x").alias("median_delta"), F.avg((F.col("x") > 0).cast("double")).alias("positive_share"))
    return point.join(ci, "test").select("test.*", "n_events", "mean_delta", "median_delta", "positive_share", "ci_low", "ci_high", "p_value")


ACTION_CONTRASTS = [("T2_minus_T1", "T2", "T1"), ("T3_minus_T1", "T3", "T1"), ("T3_minus_T2", "T3", "T2"), ("T4_minus_T1", "T4", "T1"), ("B0_minus_T1", "B0", "T1")]


def action_contrasts(cells_: DataFrame, reps: int = 5000, metrics: list[str] | None = None) -> DataFrame:
    """Event bootstrap of every action contrast by sample and group, with adjusted p within each sample and group."""
    metrics = TESTED_METRICS if metrics is None else metrics
    rows = with_full_sample(cells_)
    mean = rows.groupBy("sample", "investor_group", "event_id", "treatment_family").agg(*[F.avg(m).alias(m) for m in metrics])
    long = mean.select("sample", "investor_group", "event_id", "treatment_family", F.expr(f"stack({len(metrics)}, " + ", ".join(f"'{m}', {m}" for m in metrics) + ") as (metric, v)"))
    wide = long.groupBy("sample", "investor_group", "event_id", "metric").agg(*[F.max(F.when(F.col("treatment_family") == f, F.col("v"))).alias(f) for f in ("T1", "B0", "T2", "T3", "T4")])
    deltas = wide.select("sample", "investor_group", "event_id", "metric", F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), (F.col(c) - F.col(b)).alias("delta")) for n, c, b in ACTION_CONTRASTS])).alias("d")).select("sample", "investor_group", "event_id", "metric", "d.*")
    tests = grouped_bootstrap(deltas, ["sample", "investor_group", "contrast", "metric"], reps)
    tests = tests.withColumn("key", F.concat_ws("|", "contrast", "metric")).withColumn("p_value", F.round("p_value", 9))
    return benjamini_hochberg(tests, ["sample", "investor_group"], "key").drop("key")


def contrast_bootstrap(long: DataFrame, metric: str, reps: int = 20000) -> DataFrame:
    """Bootstrap of event means of one metric's contrasts over all_profiles, pooled and by model, with row counts and whether the interval leaves out 0."""
    rows = long.where((F.col("metric") == metric) & (F.col("investor_group") == "all_profiles") & F.col("delta").isNotNull()).withColumn("model", F.explode(F.array(F.lit("all_models"), "model_family")))
    events = rows.groupBy("contrast", "model", "event_id").agg(F.avg("delta").alias("delta"))
    size = rows.groupBy("contrast", "model").agg(F.count("*").alias("n_rows"), F.avg("delta").alias("row_mean_delta"))
    b = grouped_bootstrap(events, ["contrast", "model"], reps)
    return size.join(b, ["contrast", "model"]).withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def frozen_deltas(decisions: DataFrame, events: DataFrame, baseline: str, comparison: str, value: Column) -> DataFrame:
    """Event deltas of a frozen set of events; an event without both treatments is an error."""
    rows = decisions.join(events.select("event_id").distinct(), "event_id", "left_semi")
    mean = lambda f: F.avg(F.when(F.col("treatment_family") == f, value))
    pairs = events.select("event_id").distinct().join(rows.groupBy("event_id").agg((mean(comparison) - mean(baseline)).alias("delta")), "event_id", "left").persist()  # one row for each event; the check below fills it
    lost = [r["event_id"] for r in pairs.where("delta is null").orderBy("event_id").limit(5).collect()]
    if lost:
        raise ValueError(f"no complete pair of {baseline} and {comparison} for {lost}")
    return pairs


def test_battery(deltas: DataFrame, metric: str, reps: int = 20000, exact_most: int = 20) -> DataFrame:
    """Bootstrap of the deltas and, for the positive rate, a sign test and a sign-flip test: exact up to ``exact_most`` events."""
    from tessella.operators import inference

    out = grouped_bootstrap(deltas.withColumn("metric", F.lit(metric)), ["metric"], reps).withColumn("nonzero", F.lit(deltas.where("abs(delta) > 1e-12").count()))
    if metric != "positive_rate":
        return out
    sign = inference.sign_test(deltas).withColumnRenamed("p_value", "sign_p")
    n = deltas.count()
    flip = (inference.sign_flip(deltas) if n <= exact_most else inference.monte_carlo_sign_flip(deltas)).select(F.col("p_value").alias("flip_p"))
    return out.crossJoin(F.broadcast(sign)).crossJoin(F.broadcast(flip))  # one row each


def layer_correlations(actions: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """Spearman correlation of action metrics with the other layers over all_profiles cells, by treatment and over all; null for fewer than three pairs."""
    key = [*CELL, "investor_group"]
    left, right = ["action_hhi", "action_simpson", "same_share", "hold_share"], ["source_diversity", "category_diversity", "belief_mad"]
    m = actions.where("investor_group = 'all_profiles'").select(*key, *left).join(cell_rows.select(*key, *right), key, "left")
    m = m.withColumn("treatment_set", F.explode(F.array(F.lit("all"), "treatment_family")))
    pair = F.array(*[F.struct(F.lit(a).alias("action_metric"), F.lit(b).alias("paired_metric"), F.col(a).alias("x"), F.col(b).alias("y")) for a in left for b in right])
    p = m.select("treatment_set", F.explode(pair).alias("p")).select("treatment_set", "p.*")
    by = ["treatment_set", "action_metric", "paired_metric"]
    good = p.where("x is not null and y is not null")
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    corr = good.withColumns({c: F.round(c, 9) for c in ("x", "y")}).withColumns({"rx": rank("x"), "ry": rank("y")}).groupBy(*by).agg(F.count("*").alias("n_cells"), F.corr("rx", "ry").alias("rho"))
    every = p.select(*by).distinct()
    return every.join(corr, by, "left").select(*by, F.coalesce("n_cells", F.lit(0)).alias("n_cells"), _r(F.when(F.col("n_cells") >= 3, F.when(F.isnan("rho"), None).otherwise(F.col("rho"))), "rho"))


# -- readouts -------------------------------------------------------------------------------------


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where either is missing or b is 0."""
    return F.when(b != 0, a / b)


def unpaired_delta(means: DataFrame, left: str, right: str, metrics: list[str]) -> DataFrame:
    """Difference of two rows of treatment means."""
    one = lambda f, m: F.max(F.when(F.col("treatment_family") == f, F.col(m)))
    return means.agg(*[_r(one(left, m) - one(right, m), m) for m in metrics]).select(F.lit(f"{left}_minus_{right}").alias("contrast"), *metrics)


def means_of_present(rows: DataFrame, group_fields: list[str], value_fields: list[str]) -> DataFrame:
    """Row count and means by those group columns that the table has, of those value columns that it has; text that is no number is left out."""
    keys, values = [c for c in group_fields if c in rows.columns], [c for c in value_fields if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count("*").alias("row_count"), *[_r(F.avg(X.to_double(F.col(c))), c) for c in values])


def overall(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row with mean, median and positive share of each metric."""
    return rows.agg(F.count("*").alias("n_cells"), *[c for m in metrics for c in (_r(F.avg(m), f"{m}_mean"), _r(F.median(m), f"{m}_median"), _r(F.avg((F.col(m) > 0).cast("double")), f"{m}_positive_share"))])


def quality_readout(rows: DataFrame) -> DataFrame:
    """Accuracy of holds where the outcome is near zero, of trades, confidence against being right, and rates, by treatment.

    The names follow a published table whose formulas are not released; these
    are definitions of our own: hold-neutral over outcomes within 0.01, Brier
    score of confidence against directional accuracy, accuracy weighted by
    confidence.
    """
    right = (X.epsilon_sign(F.col("expected_return_5d")) == X.epsilon_sign(F.col("car"))).cast("double")
    code_right = (F.col("action_code") == X.epsilon_sign(F.col("car"))).cast("double")
    trade = F.col("action_code") != 0
    r = rows.where("car is not null")
    return r.groupBy("treatment_family").agg(
        F.count("*").alias("n_decisions"), F.count_distinct("event_id").alias("n_events"), _r(F.avg(right), "directional_accuracy"), _r(F.avg(code_right), "strict_action_accuracy"), _r(F.avg(F.when(trade, code_right)), "trade_only_accuracy"),
        _r(F.avg(F.when(F.abs("car") <= 0.01, (~trade).cast("double"))), "hold_neutral_accuracy"), _r(F.avg((F.col("confidence") - right) * (F.col("confidence") - right)), "confidence_brier"),
        _r(F.sum(F.col("confidence") * right) / F.sum("confidence"), "confidence_weighted_accuracy"), _r(F.avg(trade.cast("double")), "trade_rate"), _r(F.avg((~trade).cast("double")), "hold_rate"),
    )


def variance_parts(decisions: DataFrame, value: str = "expected_return_5d") -> DataFrame:
    """Variance between and within profiles of each event and treatment, their ratio and share, averaged by treatment; definitions of our own."""
    p = decisions.groupBy("event_id", "treatment_family", "profile_canonical").agg(F.avg(value).alias("m"), F.var_pop(value).alias("w"))
    c = p.groupBy("event_id", "treatment_family").agg(F.var_pop("m").alias("between"), F.avg("w").alias("within"))
    total = F.col("between") + F.col("within")
    return c.groupBy("treatment_family").agg(F.count("*").alias("n"), _r(F.avg("between"), "between_variance"), _r(F.avg("within"), "within_variance"), _r(F.avg(safe_ratio(F.col("between"), F.when(F.col("within") > 1e-12, F.col("within")))), "signal_to_noise"), _r(F.avg(F.when(total > 1e-12, F.col("between") / total)), "icc_like"))


def expected_counts(spark, events: int, upstreams: int, models: int, profiles: int, representation_seeds: int, decision_seeds: int, treatments: list[str]) -> DataFrame:
    """Rows that a complete design has, before and after the generator, by treatment: raw, ledger and canonical treatments have one representation."""
    t = F.explode(F.array(*map(F.lit, treatments))).alias("treatment")
    alone = F.col("treatment").rlike("^(T1|T4|B0)")
    base = F.lit(events * upstreams * representation_seeds)
    down = F.lit(events * models * profiles * decision_seeds)
    rep = F.when(alone, F.lit(events)).when(F.col("treatment").startswith("T3"), base * profiles).otherwise(base)
    return spark.range(1).select(t).select("treatment", rep.cast("long").alias("representations"), F.when(alone, down).otherwise(down * upstreams * representation_seeds).cast("long").alias("decisions"))


def run_summary(rows: DataFrame, cell_rows: DataFrame, long: DataFrame) -> DataFrame:
    """One row of counts: records read, usable, by code, cells, complete cells, contrast rows, unstable ones."""
    read = rows.agg(F.count("*").alias("records"), F.count_if(F.col("code").isNull()).alias("usable"), F.count_if(F.col("code") == "missing_or_unparseable_fields").alias("unparseable"), F.count_if(F.col("code") == "invalid_action").alias("invalid_actions"))
    c = cell_rows.agg(F.count("*").alias("cells"), F.count_if("is_complete_group").alias("complete_cells"))
    x = long.agg(F.count("*").alias("contrast_rows"), F.count_if(~F.col("is_stable")).alias("unstable_rows"))
    return read.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(x))  # one row each


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a report, in the order of the rows; for the few rows of a readout."""
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(text(r[c]) for c in columns) + " |" for r in rows.select(*columns).limit(1000).collect()]) + "\n"
