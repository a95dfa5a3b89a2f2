"""Column expressions shared by the operators: coercions, codes, text and set measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Treatment prefixes, action codes, numeric tolerance of signs.
FAMILIES = ("T1", "T2", "T3", "T4", "T5", "T6", "B0")
ACTION_CODES = {"buy": 1, "hold": 0, "sell": -1}
SIGN_EPSILON = 1e-12


def blank_to_null(c: Column) -> Column:
    """Text without outer white space; nothing left: null."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def to_double(c: Column) -> Column:
    """Finite numbers from numeric text only; anything else is null."""
    t = F.trim(c.cast("string"))
    v = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def to_long(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+(\.0+)?$"), F.regexp_replace(t, r"\.0+$", "").try_cast("bigint"))


def family_of(treatment: Column) -> Column:
    head = F.split_part(treatment, F.lit("_"), F.lit(1))
    return F.when(head.isin(*FAMILIES), head)


def action_code(action: Column) -> Column:
    """-1, 0, 1; null for other actions."""
    out = F.lit(None).cast("int")
    for name, code in ACTION_CODES.items():
        out = F.when(action == name, F.lit(code)).otherwise(out)
    return out


def epsilon_sign(x: Column) -> Column:
    return F.when(x > SIGN_EPSILON, 1).when(x < -SIGN_EPSILON, -1).when(x.isNotNull(), 0)


def groups_of(group: Column, known_only: bool = False) -> Column:
    """The investor groups that a row counts for: all_profiles and its own."""
    every = F.array(F.lit("all_profiles"), group)
    return F.when(group.isin("retail", "institutional"), every).otherwise(F.array(group) if known_only else every)


def bound(rows: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """Columns ``keep`` and value as ``name``, evaluated once in each row: no later filter or projection is merged into it."""
    return rows.select(*keep, value.alias(name)).select(*keep, F.explode(F.array(name)).alias(name))


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754: over zero an infinity or NaN, as the SQL has it, not an error."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def rounded(c: Column, places: int = 6) -> Column:
    """Doubles scaled, rounded half away from zero and scaled back, as the SQL engine does; Spark's round looks at the decimal digits, so halves that a double misses by one unit go the other way."""
    return F.round(c * F.lit(10.0**places), 0) / F.lit(10.0**places)


def mean_abs_difference(values: Column) -> Column:
    """Mean |x - y| over unordered pairs from the sorted values; null for fewer than two."""

    def closed(s):
        n = F.size(s)
        total = F.aggregate(F.transform(s, lambda x, i: x * (2 * (i + 1) - n - 1).cast("double")), F.lit(0.0), lambda a, x: a + x)
        return F.when(n > 1, total * 2 / (n * (n - 1)))

    return let(F.sort_array(values), closed)


def entropy_bits(counts: list[Column], n: Column) -> Column:
    terms = [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts]
    return F.when(n > 0, reduce(lambda a, b: a + b, terms))


def concentration(counts: list[Column], n: Column) -> Column:
    return F.when(n > 0, reduce(lambda a, b: a + b, [(c / n) * (c / n) for c in counts]))


def jaccard(a: Column, b: Column, both_empty: float | None) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(both_empty).cast("double"))


def mean_over_pairs(items: Column, measure) -> Column:
    """Mean of measure(x, y) over i < j of a short array; null measures are left out."""
    pairs = F.flatten(F.transform(items, lambda x, i: F.transform(F.filter(items, lambda y, j: j > i), lambda y: measure(x, y))))
    return let(F.filter(pairs, lambda v: v.isNotNull()), lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def lexical_features(text: Column) -> Column:
    """Words as ``w:`` and character trigrams of the joined text as ``c:`` features."""
    t = folded(text)
    joined = F.replace(t, F.lit(" "), F.lit("_"))
    words = F.transform(F.filter(F.split(t, " "), lambda w: w != ""), lambda w: F.concat(F.lit("w:"), w))
    grams = F.when(F.length(joined) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 2, F.lit(1))), lambda i: F.concat(F.lit("c:"), F.substring(joined, i, F.lit(3))))).when(F.length(joined) > 0, F.array(F.concat(F.lit("c:"), joined))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, grams)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos of two dense vectors; both zero: 0, one zero: 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na, nb = (F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)) for v in (a, b))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - dot / (na * nb))


def source_ids(text: Column) -> Column:
    """Distinct source ids in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])([SX]\d{3,4})(?![A-Za-z0-9])"), F.lit(1)))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+(?:[._%/-][A-Za-z0-9]+)*"))


def first_sentence(text: Column) -> Column:
    s = F.regexp_extract(text, r"^(.+?[.!?])(?:\s|$)", 1)
    return F.when(s != "", s).otherwise(text)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def hash_shard(key: Column, shards: int) -> Column:
    """Shard of the first 64 bits of the key's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(shards)).cast("int")


def next_business_day(day: Column) -> Column:
    """The next weekday; holidays are not known."""
    w = F.dayofweek(day)
    return F.date_add(day, F.when(w == 6, 3).when(w == 7, 2).otherwise(1))


def after_close(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss") > "16:00:00"


def natural_key(source_id: Column) -> Column:
    return F.struct(F.regexp_replace(source_id, r"\d", ""), F.coalesce(F.regexp_extract(source_id, r"(\d+)", 1).try_cast("bigint"), F.lit(0)), source_id)
