"""Rendering of treatments, expansion into requests, mock decisions and permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_text(units: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text for each key: its lines in order."""
    x = units.select(key, F.struct(F.col(order).alias("o"), line.alias("l")).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("a"))
    text = F.array_join(F.transform("a", lambda s: s["l"]), "\n")
    return x.select(key, F.size("a").alias("n_units"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.alias("rendered_text"))


def expand(rendered: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Every combination of the rows with short lists of models, profiles and seeds, and the request key."""
    x = rendered
    for name, values in axes.items():
        x = x.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return x.withColumn("request_key", F.concat_ws("|", *[F.col(c).cast("string") for c in [*rendered.columns, *axes]]))


def mock_decisions(requests: DataFrame, key: str = "request_key") -> DataFrame:
    """Deterministic decisions from the key's digest: expectation, action at +-0.018, confidence."""
    part = lambda i: F.conv(F.substring(F.sha2(F.col(key).cast("binary"), 256), i, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    score = (part(1) * 2 - 1) * F.lit(0.06)
    x = requests.withColumn("expected_return_5d", F.round(score, 4)).withColumn("confidence", F.round(0.4 + 0.5 * part(9), 4))
    return x.withColumn("action", F.when(score > 0.018, "buy").when(score < -0.018, "sell").otherwise("hold"))


def permuted(units: DataFrame, key: str, order: str, seed: str) -> DataFrame:
    """A permutation of each key's units by digest; where it is the identity, a rotation by one."""
    old = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    new = F.row_number().over(Window.partitionBy(key).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col(order).cast("string")).cast("binary"), 256))) - 1
    x = units.withColumn("old_index", old).withColumn("new_index", new)
    w = Window.partitionBy(key)
    n, same = F.count("*").over(w), F.min((F.col("old_index") == F.col("new_index")).cast("int")).over(w)
    return x.withColumn("_n", n).withColumn("new_index", F.when((same == 1) & (n > 1), (F.col("new_index") + 1) % n).otherwise(F.col("new_index")).cast("int")).drop("_n")


def evidence_bank(documents: DataFrame, most: int = 160) -> DataFrame:
    """Evidence units of documents: numbered sentences with a section category and a short claim."""
    from tessella.functions.text import section_of, sentences

    x = documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    from tessella.functions.expr import truncated

    return x.select("doc_id", F.concat(F.lit("E_SRC_"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("evidence_id"), section_of(F.col("sentence")).alias("category"), truncated(F.col("sentence"), most).alias("claim"), F.col("pos").alias("pos"))
