"""Dispersion metrics of decision cells and their enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import expr as X

CELL = ["event_id", "treatment_family", "model_family"]
PROFILES = [f"p{i}" for i in range(6)]


def _r(c, name):
    return F.round(c, 6).alias(name)


def with_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    return decisions.join(outcomes, "item", "left")


def with_metadata(decisions: DataFrame, metadata: DataFrame) -> DataFrame:
    return decisions.join(metadata.withColumn("event_metadata_joined", F.lit(True)), "item", "left").withColumn("event_metadata_joined", F.coalesce("event_metadata_joined", F.lit(False)))


def with_quality(rows: DataFrame) -> DataFrame:
    """Directional and action accuracy and errors against the outcome; null without one."""
    real = X.epsilon_sign(F.col("car"))
    return rows.withColumns({
        "directional_accuracy": (X.epsilon_sign(F.col("er")) == real).cast("double"),
        "action_accuracy": (X.action_code(F.col("action")) == real).cast("double"),
        "signed_error": F.col("er") - F.col("car"),
        "absolute_error": F.abs(F.col("er") - F.col("car")),
    })


def with_categories(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Categories of the cited sources and the mapped share of distinct citations (null if none is cited)."""
    cited = rows.select("row_number", F.explode(F.array_distinct("evidence")).alias("source_id"))
    found = cited.join(index, "source_id", "left").groupBy("row_number").agg(F.sort_array(F.collect_set("category")).alias("categories"), F.count_distinct("source_id").alias("cited"), F.count_distinct(F.when(F.col("category").isNotNull(), F.col("source_id"))).alias("mapped"))
    return rows.join(found.withColumn("coverage", F.col("mapped") / F.col("cited")), "row_number", "left")


def replicated(rows: DataFrame, known_only: bool = False) -> DataFrame:
    return rows.withColumn("investor_group", F.explode(X.groups_of(F.col("profile_group"), known_only)))


def cell_metrics(decisions: DataFrame) -> DataFrame:
    """One pass over all groups: counts, spread, entropy, concentration, belief distance, completeness.

    Cells with a profile that occurs twice are left out.
    """
    single = decisions.groupBy(*CELL, "profile").agg(F.count("*").alias("c")).groupBy(*CELL).agg(F.max("c").alias("most")).where("most = 1").drop("most")
    rows = replicated(decisions.join(single, CELL, "left_semi"))
    counts = {a: F.count_if(F.col("action") == a) for a in X.ACTION_CODES}
    n = F.count("*")
    expected = F.when(F.col("investor_group") == "all_profiles", F.lit(6)).otherwise(3)
    m = rows.groupBy(*CELL, "investor_group").agg(
        n.alias("profile_count"), F.avg("er").alias("mean_er"), F.stddev_pop("er").alias("sd"), (F.percentile("er", F.lit(0.75)) - F.percentile("er", F.lit(0.25))).alias("iqr"),
        F.collect_list("er").alias("ers"), X.entropy_bits(list(counts.values()), n).alias("entropy"), X.concentration(list(counts.values()), n).alias("hhi"),
        F.abs(F.avg(X.action_code(F.col("action")))).alias("net"), F.array_join(F.sort_array(F.array_except(F.array(*map(F.lit, PROFILES)), F.collect_set("profile"))), ",").alias("absent"),
    )
    return m.select(
        *CELL, "investor_group", "profile_count", F.expr("profile_count * (profile_count - 1) div 2").alias("pair_count"), (F.col("profile_count") == expected).alias("complete"),
        F.when(F.col("investor_group") == "all_profiles", F.col("absent")).otherwise("").alias("missing_profiles"), _r("mean_er", "mean_er"), _r("sd", "er_sd"), _r("iqr", "er_iqr"),
        _r(X.mean_abs_difference(F.col("ers")), "belief_mad"), _r("entropy", "action_entropy"), _r("hhi", "action_hhi"), _r(1 - F.col("hhi"), "action_simpson"), _r("net", "net_direction"), _r(1 - F.col("net"), "net_dispersion"),
    )


def set_metrics(decisions: DataFrame) -> DataFrame:
    """Mean pairwise overlap of sources (two empty sets: 1) and distance (two empty sets: left out)."""
    m = decisions.groupBy(*CELL).agg(F.collect_list("evidence").alias("sets"))
    return m.select(*CELL, _r(X.mean_over_pairs(F.col("sets"), lambda a, b: X.jaccard(a, b, 1.0)), "source_overlap"), _r(X.mean_over_pairs(F.col("sets"), lambda a, b: 1 - X.jaccard(a, b, None)), "source_distance"))


def category_metrics(decisions: DataFrame, index: DataFrame) -> DataFrame:
    """Category overlap, null unless every member has categories and some coverage."""
    m = with_categories(decisions, index).groupBy(*CELL).agg(F.avg("coverage").alias("coverage"), F.bool_and(F.size("categories") > 0).alias("all_have"), F.collect_list("categories").alias("sets"))
    ok = F.col("all_have") & (F.col("coverage") > 0)
    return m.select(*CELL, _r("coverage", "coverage"), F.when(ok, F.round(X.mean_over_pairs(F.col("sets"), lambda a, b: X.jaccard(a, b, 1.0)), 6)).alias("category_overlap"))


def quality_metrics(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL).agg(*[_r(F.avg(c), c) for c in ("directional_accuracy", "action_accuracy", "signed_error", "absolute_error")])


def action_cells(decisions: DataFrame) -> DataFrame:
    """Action counts, shares, trade rate, normalised entropy and share of equal pairs."""
    n = F.count("*")
    c = {a: F.count_if(F.col("action") == a) for a in ("buy", "hold", "sell")}
    pairs = sum((v * (v - 1) / 2 for v in c.values()), F.lit(0.0))
    return decisions.groupBy(*CELL).agg(
        n.alias("n"), *[v.alias(f"n_{a}") for a, v in c.items()], *[_r(v / n, f"share_{a}") for a, v in c.items()], _r(1 - c["hold"] / n, "trade_rate"),
        _r(X.entropy_bits(list(c.values()), n) / F.log2(F.lit(3.0)), "entropy_norm"), _r(F.when(n > 1, pairs / (n * (n - 1) / 2)), "same_share"), _r(F.avg("confidence"), "mean_confidence"),
    )


def text_cells(rows: DataFrame, text: str = "text") -> DataFrame:
    """Share and length of texts and their mean pairwise lexical distance; cells of one row are left out."""
    # each distinct pair of texts is measured once, however many cells hold it
    keyed = rows.select(F.concat_ws("|", *CELL).alias("grp"), "row_number", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("t"), text)
    x, y = keyed.select("grp", "row_number", "t").alias("x"), keyed.select("grp", "row_number", "t").alias("y")
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.row_number") < F.col("y.row_number"))).select(F.col("x.grp").alias("grp"), F.least("x.t", "y.t").alias("a"), F.greatest("x.t", "y.t").alias("b"))
    distance = pairs.join(text_pair_distances(pairs.select("a", "b").distinct(), keyed.groupBy("t").agg(F.first(text).alias("text"))), ["a", "b"]).groupBy("grp").agg(F.avg("distance").alias("d"))
    m = rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg((F.length(text) > 0).cast("double")).alias("share"), F.avg(F.length(text)).alias("chars")).where("n > 1").withColumn("grp", F.concat_ws("|", *CELL))
    return m.join(distance, "grp", "left").select(*CELL, "n", _r("share", "nonempty_share"), _r("chars", "mean_chars"), _r("d", "text_distance"))


def text_pair_distances(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, distance) of given pairs of text keys; texts is (t, text)."""
    tf = texts.select("t", F.explode(X.lexical_features(F.col("text"))).alias("f")).groupBy("t", "f").agg(F.count("*").cast("double").alias("tf"))
    norms = tf.groupBy("t").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    one, two = tf.select(F.col("t").alias("a"), "f", F.col("tf").alias("u")), tf.select(F.col("t").alias("b"), "f", F.col("tf").alias("v"))
    dots = pairs.join(one, "a").join(two, ["b", "f"]).groupBy("a", "b").agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    n = norms.select(F.col("t").alias("a"), F.col("norm").alias("na")), norms.select(F.col("t").alias("b"), F.col("norm").alias("nb"))
    d = F.when(F.col("na").isNull() & F.col("nb").isNull(), 0.0).when(F.col("na").isNull() | F.col("nb").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))))
    return pairs.join(n[0], "a", "left").join(n[1], "b", "left").join(dots, ["a", "b"], "left").select("a", "b", d.alias("distance"))


def lexical_distances(texts: DataFrame, text: str = "text") -> DataFrame:
    """(grp, a, b, distance) for pairs a < b of each group; features are joined, so pairs without common ones stay at 1."""
    tf = texts.select("grp", "id", F.explode(X.lexical_features(F.col(text))).alias("f")).groupBy("grp", "id", "f").agg(F.count("*").cast("double").alias("tf"))
    norms = texts.select("grp", "id").join(tf.groupBy("grp", "id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm")), ["grp", "id"], "left")
    a, b = tf.alias("a"), tf.alias("b")
    dots = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.f") == F.col("b.f")) & (F.col("a.id") < F.col("b.id"))).groupBy(F.col("a.grp").alias("grp"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.sum(F.col("a.tf") * F.col("b.tf")).alias("dot"))
    p, q = norms.alias("p"), norms.alias("q")
    pairs = p.join(q, (F.col("p.grp") == F.col("q.grp")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.grp").alias("grp"), F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.norm").alias("na"), F.col("q.norm").alias("nb"))
    d = F.when(F.col("na").isNull() & F.col("nb").isNull(), 0.0).when(F.col("na").isNull() | F.col("nb").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))))
    return pairs.join(dots, ["grp", "a", "b"], "left").select("grp", "a", "b", d.alias("distance"))


def pair_distances(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Number of pairs of each group and mean cosine distance over them, from sums of unit vectors instead of the pairs.

    The cosines of all pairs add up to (|sum of units|^2 - number) / 2. As in
    ``cosine_distance`` a zero vector is 1 from others and 0 from another zero
    one. A null vector or component, or lengths that differ, make a pair that
    counts and has no distance; a NaN or infinite component one of NaN.
    """
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))  # null where a part is
    r = rows.where(F.col(by).isNotNull()).select(by, v.alias("v"), norm.alias("norm"), F.size(v).alias("d"))
    size = r.groupBy(by).agg(F.count("*").alias("n"))
    good = r.where("norm is not null")
    counts = good.groupBy(by, "d").agg(F.count("*").alias("k"), F.count_if(F.col("norm") == 0).alias("zeros"))
    parts = good.where("norm <> 0").select(by, "d", F.posexplode(F.transform("v", lambda x: x / F.col("norm"))).alias("at", "u"))
    sums = parts.groupBy(by, "d", "at").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q")).groupBy(by, "d").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("twice"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cosines = F.when(F.col("k") - F.col("zeros") > 1, F.col("twice") / 2).otherwise(0.0) + pairs("zeros")
    g = counts.join(sums, [by, "d"], "left").groupBy(by).agg(F.sum(pairs("k")).alias("measured"), F.sum(cosines).alias("cosines"))
    mean = F.when(F.col("measured") > 0, 1 - F.col("cosines") / F.col("measured"))
    return size.where("n > 1").join(g, by, "left").select(by, pairs("n").cast("long").alias("pairs"), F.round(mean, 6).alias("mean_distance"), F.round(mean / 2, 6).alias("mean_normalised"))
