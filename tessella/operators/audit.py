"""Validation, leakage scans, manifests and comparison of evidence."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leakage rules, name: (severity, pattern).
LEAKAGE = {
    "email": ("high", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]"),
    "url": ("medium", r"https?://[A-Za-z0-9./_-]+"),
    "phone": ("medium", r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b"),
    "version": ("low", r"[Vv]ersion [0-9]+"),
}
SEVERITY = {"low": 1, "medium": 2, "high": 3}
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_NAME = r"[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+){1,2}"
_STATES = r"Ala|Alaska|Ariz|Ark|Calif|Colo|Conn|Del|Fla|Ga|Ill|Ind|Iowa|Kan|Ky|La|Md|Mass|Mich|Minn|Mo|Nev|N\.J|N\.Y|N\.C|Ohio|Okla|Ore|Pa|Tenn|Texas|Utah|Va|Wash|Wis"
#: Masking rules, name: (severity, pattern), in the order of the findings.
MASKING = {
    "exchange_ticker": ("high", re.compile(r"\b(?:Nasdaq|NASDAQ|NYSE|NYSE American|AMEX|OTC|Cboe)\s*[:：]\s*(?!Company\s+[A-Z]\b)[A-Z][A-Z.\-]{0,7}\b")),
    "accession_number": ("high", re.compile(r"\b\d{10}-\d{2}-\d{6}\b")),
    "cik_reference": ("high", re.compile(r"\bCIK\s*[:#]?\s*\d{6,10}\b", re.I)),
    "email": ("high", re.compile(r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", re.I)),
    "url": ("medium", re.compile(r"\b(?:https?://|www\.)[^\s<>)\"']+", re.I)),
    "domain": ("medium", re.compile(r"\b(?!Company\s+A\.com\b)[A-Za-z0-9][A-Za-z0-9.-]{1,}\.(?:com|net|org|io|ai|co|us|edu|gov)\b", re.I)),
    "executive_name_before_title": ("medium", re.compile(rf"\b{_NAME}\s*,\s*(?:chair|chairman|chairwoman|chairperson|ceo|cfo|coo|president|chief\s+[a-z ]+officer|founder|general counsel)\b", re.I)),
    "executive_name_after_said": ("medium", re.compile(rf"\b(?:said|stated|commented|noted|added)\s+{_NAME}\b")),
    "exact_calendar_date": ("medium", re.compile(rf"\b{_MONTH}\.?\s+\d{{1,2}}(?:,\s+\d{{4}})?\b", re.I)),
    "specific_place": ("medium", re.compile(rf"\b[A-Z][A-Z .'-]{{2,}},\s+(?:{_STATES})\.?\b")),
    "distinctive_metric": ("low", re.compile(r"\b(?:ARR|annualized recurring revenue|remaining performance obligations|\bRPO\b|same-store sales|comparable store sales|bookings|backlog|net retention|gross merchandise value|GMV|annual recurring revenue)\b", re.I)),
    "transaction_language": ("low", re.compile(r"\b(?:acquisition|merger|divestiture|spin-?off|tender offer|regulatory approval|closing conditions)\b", re.I)),
}
_NO_PERSON = {"chief", "executive", "financial", "operating", "officer", "president"}
#: Characters of context on each side, and most characters of a match and of its context.
_RADIUS, _MATCH, _CONTEXT = 80, 160, 260


def decision_errors(ids: Column | None = None) -> Column:
    """Array of (field, code) for everything wrong with a decision row."""
    e = lambda cond, f, c: F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(c).alias("code")))
    checks = [
        e(F.col("er").isNull(), "expected_return_5d", "missing"), e(F.abs("er") > 0.15, "expected_return_5d", "out_of_range"), e(~F.col("confidence").between(0.05, 0.95), "confidence", "out_of_range"),
        e(~F.col("action").isin("buy", "hold", "sell"), "action", "invalid_enum"), e(F.size("evidence") < 3, "evidence_used", "too_few_items"), e((F.col("action") == "buy") & (F.col("er") < 0), "action", "sign_mismatch"),
    ]
    if ids is not None:
        checks.append(e(F.size(F.array_except("evidence", ids)) > 0, "evidence_used", "unknown_source_id"))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validation_report(decisions: DataFrame, ids: Column | None = None) -> DataFrame:
    return decisions.select(F.inline(decision_errors(ids))).groupBy("field", "code").agg(F.count("*").alias("n"))


def quarantined(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantine): the second carries its errors."""
    x = rows.withColumn("errors", errors)
    return x.where(F.size("errors") == 0).drop("errors"), x.where(F.size("errors") > 0)


def leakage_scan(texts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text and rule that matches: count, first match, severity."""
    hits = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_count(F.col(text), F.lit(p)).alias("n"), F.regexp_extract(F.col(text), f"({p})", 1).alias("first_match")) for n, (s, p) in LEAKAGE.items()])
    return texts.select(ident, F.inline(F.filter(hits, lambda h: h["n"] > 0)))


def leakage_summary(findings: DataFrame, ident: str = "doc_id") -> DataFrame:
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    risk = findings.groupBy(ident).agg(F.max(rank).alias("risk"))
    return risk.groupBy("risk").agg(F.count("*").alias("n_records"))


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 3].rstrip() + "..."


def _masking_hits(text):
    flat, found = " ".join((text or "").split()), []
    for rule, (severity, pattern) in MASKING.items():
        for m in pattern.finditer(flat):
            if rule.startswith("executive_name") and _NO_PERSON & {t.lower().strip(".,") for t in m.group(0).split()}:
                continue
            around = flat[max(0, m.start() - _RADIUS) : m.end() + _RADIUS]
            found.append((rule, severity, _cut(m.group(0), _MATCH), _cut(" ".join(around.split()), _CONTEXT)))
    return found


def masking_findings(texts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule, severity, match, context): a row for every match of every masking rule, white space folded."""
    hits = F.udf(_masking_hits, "array<struct<rule:string,severity:string,match:string,context:string>>")
    return texts.select(ident, F.inline(hits(F.col(text).cast("string"))))


def _json_leaves(payload):
    try:
        # numbers keep their spelling; only strings are texts
        top = json.loads(payload or "null", parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError:
        return []
    out, todo = [], [("$", top)] if isinstance(top, (dict, list)) else []
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += reversed([(f"{path}.{k}", v) for k, v in value.items()])
        elif isinstance(value, list):
            todo += reversed([(f"{path}[{i}]", v) for i, v in enumerate(value)])
        elif isinstance(value, bool):
            out.append((path, str(value).lower(), False))
        else:
            out.append((path, None if value is None else str(value), type(value) is str))
    return out


class _Number(str):
    """A JSON number as it is written."""


def _leaves(payload: str):
    walk = F.udf(_json_leaves, "array<struct<path:string,value:string,is_text:boolean>>")
    return F.inline(walk(F.col(payload).cast("string")))


def json_fields(rows: DataFrame, ident: str, payload: str) -> DataFrame:
    """(id, path, value) of every scalar in JSON objects and arrays of any depth; no rows for what is not JSON."""
    return rows.select(ident, _leaves(payload)).select(ident, "path", "value")


def json_masking_findings(rows: DataFrame, ident: str, payload: str) -> DataFrame:
    """(id, path, rule, severity, match, context) for every text in JSON records of any depth."""
    texts = rows.select(ident, _leaves(payload)).where("is_text").select(F.struct(ident, "path").alias("_at"), "value")
    return masking_findings(texts, "_at", "value").select("_at.*", "rule", "severity", "match", "context")


def duplicate_identities(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def last_of_key(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(ordinal))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of_key(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.asc(ordinal))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def remaining(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs whose key no earlier run has produced."""
    return jobs.join(done.select(*key).distinct(), key, "left_anti")


def compare_units(bank: DataFrame, rendered: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Missing, extra, duplicate and differing units of a rendering."""
    r = rendered.groupBy(*key).agg(F.count("*").alias("copies"), *[F.first(f).alias(f"r_{f}") for f in fields])
    x = bank.select(*key, *fields, F.lit(True).alias("in_bank")).join(r, key, "full")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"r_{f}"))
    status = F.when(F.col("copies").isNull(), "missing").when(F.col("in_bank").isNull(), "extra").when(F.col("copies") > 1, "duplicate").when(~same, "mismatch").otherwise("equal")
    return x.select(*key, status.alias("status"))


def frozen(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """One row: count and a digest of all rows that does not depend on their order."""
    each = F.sha2(F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = F.conv(F.substring(each, 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), (F.sum(part) % F.lit(1 << 48)).cast("bigint").alias("digest"))


def matrix_findings(rows: DataFrame, visible: DataFrame, prior_arms: list[str], replay_arm: str) -> DataFrame:
    """Prior-only arms must cite nothing; replay citations must be visible in the event's packet."""
    x = rows.join(visible, "event_id", "left").withColumn("visible_ids", F.coalesce("visible_ids", F.array().cast("array<string>")))
    prior = F.col("treatment").isin(prior_arms) & (F.size("evidence_used") > 0)
    unseen = (F.col("treatment") == replay_arm) & (F.size(F.array_except("evidence_used", "visible_ids")) > 0)
    code = F.when(prior, "citation_in_prior_arm").when(unseen, "citation_not_visible")
    return x.withColumn("code", code).where("code is not null")
