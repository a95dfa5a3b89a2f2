"""Permissive and strict loaders, canonical JSON and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECISION = T.StructType([T.StructField(n, T.StringType()) for n in ("event_id", "treatment", "profile", "profile_group", "model_family", "upstream_model_family", "representation_seed", "decision_seed", "expected_return_5d", "confidence", "action", "action_strength")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("key_reasons", "evidence_used", "evidence_categories", "uncertainty_notes")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = DECISION, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines with file and a number that rises with the line (intake.sniffed counts lines); blank lines are skipped. Strict: a bad line fails."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal")).where("trim(value) <> ''")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    mode = "FAILFAST" if strict else "PERMISSIVE"
    x = lines.withColumn("r", F.from_json("value", schema if strict else wide, {"mode": mode} | ({} if strict else {"columnNameOfCorruptRecord": "_bad"})))
    if strict:
        return x.select("file", "ordinal", "r.*"), x.limit(0)
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return x.where(~bad).select("file", "ordinal", "r.*").drop("_bad"), x.where(bad).select("file", "ordinal", F.lit("invalid_json").alias("code"), "value")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents of a folder, one for each file, with the file's path."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_path"))


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header; a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", "true").csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def first_available(df: DataFrame, names: list[str]) -> Column | None:
    lower = {c.lower(): c for c in df.columns}
    return next((F.col(lower[n.lower()]) for n in names if n.lower() in lower), None)


def filing_rows(payload: DataFrame, columns: list[str]) -> DataFrame:
    """Parallel arrays as rows; a short array gives nulls."""
    return payload.select(F.explode(F.arrays_zip(*[F.col(c) for c in columns])).alias("r")).select("r.*")


def filing_documents(text: Column) -> Column:
    """<DOCUMENT> blocks of a submission as (type, sequence, filename, text)."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    tag = lambda b, n: F.trim(F.regexp_extract(b, rf"(?i)<{n}>([^\n<]*)", 1))
    return F.transform(blocks, lambda b: F.struct(tag(b, "TYPE").alias("type"), tag(b, "SEQUENCE").alias("sequence"), tag(b, "FILENAME").alias("filename"), F.regexp_extract(b, r"(?is)<TEXT>(.*?)</TEXT>", 1).alias("text")))


def unique_or_fail(df: DataFrame, key: list[str], what: str) -> DataFrame:
    bad = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"{what}: duplicate {bad[0].asDict()}")
    return df


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Sorted fields, nulls kept, compact."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed column order; arrays as compact JSON, null as nothing."""
    kinds = dict(df.dtypes)
    df.select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").partitionBy(column).json(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
