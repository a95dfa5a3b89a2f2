"""Edit manifests: repair and strict reading of lines, adjudication, and application to evidence units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T

KEY = ["event_id", "evidence_id"]
# Fields of a manifest line; those that must equal the bank's; reason of an approval.
FIELDS = "event_id string, evidence_id string, category string, value string, source_ids array<string>, support_label string, original_claim string, approved boolean, proposed_t5_claim string"
REQUIRED = ["event_id", "evidence_id", "category", "value", "source_ids", "support_label", "approved", "proposed_t5_claim"]
MATCHED = ["category", "value", "source_ids", "support_label"]
APPROVAL = "author_approved_fact_preserving_local_deframing"


def strict_json(line: Column) -> Column:
    """A line with Python's True and False after a colon as JSON's."""
    for word in ("true", "false"):
        line = F.regexp_replace(line, rf"(:\s*){word.capitalize()}(?=\s*[,}}])", f"$1{word}")
    return line


def line_error(line: Column) -> Column:
    """What is wrong with a manifest line, else null: blank, not JSON, fields that lack, or a value of the wrong type."""
    keys, kind = F.json_object_keys(line), lambda f: F.get_json_object(line, f"$.{f}")
    lacking = F.array_except(F.array(*map(F.lit, REQUIRED)), keys)
    quoted = lambda f: line.rlike(rf'"{f}"\s*:\s*"')
    return (
        F.when(F.trim(line) == "", "blank")
        .when(keys.isNull(), "not a JSON object")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing fields: "), F.array_join(lacking, ", ")))
        .when(F.coalesce(kind("event_id"), F.lit("")) == "", "invalid event_id")
        .when(F.coalesce(kind("evidence_id"), F.lit("")) == "", "invalid evidence_id")
        .when(~line.rlike(r'"approved"\s*:\s*(?:true|false)'), "approved must be boolean")
        .when(~quoted("proposed_t5_claim"), "proposed_t5_claim must be a string")
    )


def read_manifest(spark: SparkSession, path: str, repair: bool = False) -> DataFrame:
    """Manifest rows of a JSON-lines file; fails on any bad line, on a repeated key and on an empty file."""
    lines = spark.read.text(path).select((strict_json(F.col("value")) if repair else F.col("value")).alias("line"))
    bad = lines.select(line_error(F.col("line")).alias("error"), "line").where("error is not null").limit(5).collect()
    if bad:
        raise ValueError("manifest: " + "; ".join(f"{r.error}: {r.line[:80]!r}" for r in bad))
    rows = lines.select(F.from_json("line", FIELDS).alias("r")).select("r.*")
    twice = rows.groupBy(*KEY).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError("manifest keys repeated: " + ", ".join(f"{r.event_id}/{r.evidence_id}" for r in twice))
    if rows.isEmpty():
        raise ValueError(f"manifest is empty: {path}")
    return rows


def adjudicated(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manifest rows with their decision laid over them.

    ``decisions`` has the key, ``claim`` (null: rejected), ``spans`` (array of
    text and categories) and ``reason``. An approved row takes the claim and
    its spans with their places in the original; a rejected one keeps the
    original claim; a row without a decision stays.
    """
    d = F.struct(*[c for c in decisions.columns if c not in KEY]).alias("_d")
    both = rows.join(decisions.select(*KEY, d), KEY, "left")
    known, yes = F.col("_d").isNotNull(), F.col("_d.claim").isNotNull()
    at = lambda s: (F.position(s["text"], F.col("original_claim")) - 1).cast("int")
    spans = F.array_sort(F.transform("_d.spans", lambda s: F.struct(at(s).alias("start_char"), (at(s) + F.length(s["text"])).cast("int").alias("end_char"), s["text"].alias("text"), F.array_sort(s["categories"]).alias("categories"))))
    return both.withColumns(
        {
            "approved": F.when(known, yes).otherwise(F.col("approved")),
            "review_status": F.when(yes, "approved").when(known, "rejected"),
            "proposed_t5_claim": F.when(yes, F.col("_d.claim")).when(known, F.col("original_claim")).otherwise(F.col("proposed_t5_claim")),
            "candidate_frame_spans": F.when(yes, spans),
            "candidate_frame_categories": F.when(yes, F.array_sort(F.array_distinct(F.flatten(F.transform("_d.spans", lambda s: s["categories"]))))),
            "adjudication_reason": F.when(yes, APPROVAL).when(known, F.col("_d.reason")),
        }
    ).drop("_d")


def undecided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keys that only the candidates (missing) or only the decisions (extra) have; empty when both agree."""
    a, b = rows.select(*KEY).distinct().withColumn("a", F.lit(1)), decisions.select(*KEY).distinct().withColumn("b", F.lit(1))
    return a.join(b, KEY, "full").where("a is null or b is null").select(*KEY, F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("side"))


def applied(units: DataFrame, manifest: DataFrame) -> DataFrame:
    """Evidence units with approved claims in place, ``changed``, and ``error`` where the manifest does not fit.

    A unit must have a manifest row of the same claim, category, value, source
    ids and label, and an approved claim must hold the same protected tokens;
    units with an error keep their claim.
    """
    m = manifest.select(*KEY, F.struct("original_claim", *MATCHED, "approved", "proposed_t5_claim").alias("_m"))
    both, get = units.join(m, KEY, "left"), lambda f: F.col("_m")[f]
    differs = F.coalesce(*[F.when(~get(f).eqNullSafe(F.col(f)), F.lit(f"{f} does not match")) for f in MATCHED])
    tokens = lambda c: F.array_sort(F.transform(T.protected_tokens(c), F.lower))
    error = (
        F.when(F.col("_m").isNull(), "missing manifest key")
        .when(~get("original_claim").eqNullSafe(F.col("claim")), "original claim does not match")
        .when(differs.isNotNull(), differs)
        .when(get("approved") & (tokens(get("proposed_t5_claim")) != tokens(F.col("claim"))), "alters protected tokens")
    )
    both = both.withColumn("error", error)
    after = F.when(F.col("error").isNull() & get("approved"), get("proposed_t5_claim")).otherwise(F.col("claim"))
    return both.withColumns({"changed": ~after.eqNullSafe(F.col("claim")), "claim": after}).drop("_m")
