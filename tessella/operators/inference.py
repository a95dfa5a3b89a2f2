"""Event-clustered resampling, exact tests and multiplicity control.

Draws come from md5 of (replicate, slot), so every engine draws alike;
``numpy_bootstrap`` draws from NumPy's generator instead.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _r(c, name):
    return F.round(c, 6).alias(name)


def event_deltas(decisions: DataFrame, baseline: str, comparison: str, value: str = "er") -> DataFrame:
    """(event_id, delta): event means of the comparison minus the baseline; events with both only."""
    mean = lambda f: F.avg(F.when(F.col("treatment_family") == f, F.col(value)))
    return decisions.groupBy("event_id").agg((mean(comparison) - mean(baseline)).alias("delta")).where("delta is not null")


_MD5_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_words(words: list) -> tuple:
    """The first two words of the md5 of messages of one block, each of the 16 words an array or a number."""
    a, b, c, d = (np.full_like(words[0], x) for x in _MD5_START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_MD5_SINES[i])
        if not isinstance(words[g], int):
            f += words[g]
        elif words[g]:
            f += np.uint32(words[g])
        turn = _MD5_TURNS[i // 16][i % 4]
        high = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, b, c, d = d, f, b, c
    return a + np.uint32(_MD5_START[0]), b + np.uint32(_MD5_START[1])


def md5_heads(rep: int, slots: int, step: int = 16384, few: int = 1000) -> np.ndarray:
    """The first 48 bits of md5("rep:slot") for every slot below ``slots``; up to ``few`` at a time are hashed one by one."""
    out = np.empty(slots, np.int64)
    head = np.frombuffer(b"%d:" % rep, np.uint8)
    start, low = hashlib.md5(head.tobytes(), usedforsecurity=False), 0
    while low < slots:
        digits = len(str(low))
        high = min(slots, low + step, 10**digits)  # slots with the same number of digits
        if high - low <= few:
            for k in range(low, high):
                h = start.copy()
                h.update(b"%d" % k)
                out[k] = int.from_bytes(h.digest()[:6])
            low = high
            continue
        slot, used = np.arange(low, high), len(head) + digits
        text = np.zeros((high - low, used // 4 * 4 + 4), np.uint8)
        text[:, : len(head)] = head
        for k in range(digits):
            text[:, len(head) + k] = 48 + slot // 10 ** (digits - 1 - k) % 10
        text[:, used] = 0x80
        words = list(np.ascontiguousarray(text.view("<u4").T))
        a, b = _md5_words(words + [0] * (14 - len(words)) + [8 * used, 0])
        out[low:high] = a.byteswap().astype(np.int64) << 16 | (b & np.uint32(0xFFFF)).astype(np.uint16).byteswap()
        low = high
    return out


def replicate_means(values: DataFrame, by: list[str], value: str, reps: int) -> DataFrame:
    """(by, rep, mu): the mean of each replicate of each test; ``values`` has one row for each test and event, in the order of event_id.

    Slot k of a replicate takes the value at md5("rep:k") modulo the test's
    number of events, so one list of digests serves all tests. Replicates are
    dealt out in parts; each part meets the values of every test, 8 bytes each.
    """
    v = values.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col(value).alias("x")))), lambda s: s["x"]).alias("v"))
    per = max(1, -(-reps // 48))
    parts = -(-reps // per)
    kinds = dict(values.dtypes)
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rep long, mu double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = sorted({len(x) for x in pdf["v"]})
        first = int(pdf["part"].iloc[0]) * per
        last = min(reps, first + per)
        mu = np.empty((last - first, len(pdf)))
        for rep in range(first, last):
            digests = md5_heads(rep, sizes[-1])
            draws = {n: digests[:n] % n for n in sizes}
            mu[rep - first] = [x[draws[len(x)]].mean() for x in pdf["v"]]
        tests = pdf[by].iloc[np.tile(np.arange(len(pdf)), last - first)]
        return tests.assign(rep=np.repeat(np.arange(first, last), len(pdf)), mu=mu.ravel())

    dealt = v.crossJoin(F.broadcast(values.sparkSession.range(parts).withColumnRenamed("id", "part")))  # at most 48 rows
    return dealt.repartition(parts, "part").groupBy("part").applyInPandas(run, out)  # a fixed number: small parts would be merged into one task


def bootstrap(deltas: DataFrame, reps: int = 20000) -> DataFrame:
    """Mean, percentile interval and two-sided p of the event bootstrap."""
    means = replicate_means(deltas, [], "delta", reps)
    tail = F.least(F.avg((F.col("mu") <= 0).cast("double")), F.avg((F.col("mu") >= 0).cast("double")))
    ci = means.agg(_r(F.percentile("mu", F.lit(0.025)), "ci_low"), _r(F.percentile("mu", F.lit(0.975)), "ci_high"), _r(2 * tail, "p_unclipped"), _r(F.least(F.lit(1.0), 2 * tail), "p_value"))
    point = deltas.agg(F.count("*").alias("n_events"), _r(F.avg("delta"), "mean_delta"), _r(F.median("delta"), "median_delta"), _r(F.avg((F.col("delta") > 0).cast("double")), "positive_share"))
    return point.crossJoin(F.broadcast(ci))


def numpy_bootstrap(values: DataFrame, by: str, value: str, reps: int = 5000, seed: int = 20260507) -> DataFrame:
    """One row for each group, drawn with NumPy's default generator in the order of event_id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("event_id")[value].dropna().to_numpy()
        if not len(v):
            return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [0], "mean": [None], "ci_low": [None], "ci_high": [None], "p_value": [None]})
        m = np.random.default_rng(seed).choice(v, size=(reps, len(v))).mean(axis=1)
        p = min(1.0, 2 * min((m <= 0).mean(), (m >= 0).mean()))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(v)], "mean": [v.mean()], "ci_low": [np.quantile(m, 0.025)], "ci_high": [np.quantile(m, 0.975)], "p_value": [p]})

    return values.groupBy(by).applyInPandas(run, f"{by} string, n long, mean double, ci_low double, ci_high double, p_value double")


def sign_test(deltas: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Exact two-sided sign test on the non-zero deltas."""
    s = deltas.agg(F.count_if(F.col("delta") > tolerance).alias("plus"), F.count_if(F.col("delta") < -tolerance).alias("minus"))
    n, k = F.col("plus") + F.col("minus"), F.least("plus", "minus")
    # binomial tail by the ratio of neighbouring terms, from the logarithm of the first
    term = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.struct(F.lit(0.0).alias("s"), (-n * F.log(F.lit(2.0))).alias("l")), lambda a, i: F.struct((a["s"] + F.exp(a["l"])).alias("s"), (a["l"] + F.log((n - i).cast("double") / (i + 1))).alias("l")), lambda a: a["s"])
    return s.select("plus", "minus", _r(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * term)), "p_value"))


def sign_flip(deltas: DataFrame, most: int = 20) -> DataFrame:
    """Exact paired sign-flip test over all 2^n patterns, n <= most, spread over the cluster."""
    n = deltas.count()
    if n > most:
        raise ValueError(f"{n} pairs; exact enumeration takes at most {most}")
    v = deltas.agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "delta"))), lambda s: s["delta"]).alias("v"))
    flips = deltas.sparkSession.range(1 << n).crossJoin(F.broadcast(v))
    total = F.aggregate(F.transform("v", lambda d, i: F.when((F.expr("id") / F.pow(F.lit(2.0), i)).cast("bigint") % 2 == 1, -d).otherwise(d)), F.lit(0.0), lambda a, x: a + x)
    seen = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return flips.agg(F.count("*").alias("permutations"), _r(F.avg((F.abs(total) >= F.abs(seen) - 1e-12).cast("double")), "p_value"))


def monte_carlo_sign_flip(deltas: DataFrame, reps: int = 2000) -> DataFrame:
    """Sign-flip test by md5 bits."""
    draws = deltas.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(deltas)
    bit = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "event_id").cast("binary")), 1, 1), 16, 10).cast("int") % 2
    sums = draws.groupBy("rep").agg(F.sum(F.when(bit == 1, -F.col("delta")).otherwise(F.col("delta"))).alias("s"))
    seen = deltas.agg(F.abs(F.sum("delta")).alias("t"))
    return sums.crossJoin(F.broadcast(seen)).agg(F.count("*").alias("draws"), _r((F.count_if(F.abs("s") >= F.col("t") - 1e-12) + 1) / (F.count("*") + 1), "p_value"))


def benjamini_hochberg(tests: DataFrame, family: list[str], key: str, p: str = "p_value") -> DataFrame:
    """Step-up adjusted p within each family; null p stays null and is not counted."""
    some = tests.where(F.col(p).isNotNull())
    w = Window.partitionBy(*family)
    ranked = some.withColumn("rank", F.row_number().over(w.orderBy(p, key))).withColumn("m", F.count("*").over(w))
    back = w.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    out = ranked.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(back))).drop("rank", "m")
    return out.unionByName(tests.where(F.col(p).isNull()).withColumn("q_value", F.lit(None).cast("double")))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks, for groups of at least three pairs."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    return r.withColumn("rx", rank(x)).withColumn("ry", rank(y)).groupBy(*by).agg(F.count("*").alias("n"), _r(F.corr("rx", "ry"), "rho")).where("n >= 3")


def _t_tail(t: float, df: int) -> float:
    """P(T > t) of Student's t, by integration of the density."""
    x = np.linspace(0, abs(t), 20001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    area = float(np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x))
    return 0.5 - area if t >= 0 else 0.5 + area


def equivalence(deltas: DataFrame, margin: float = 0.03) -> dict:
    """Two one-sided t tests against +-margin; only n, mean and deviation reach the driver."""
    r = deltas.agg(F.count("delta").alias("n"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("s")).first()
    if r["n"] < 2 or not r["s"]:
        return {"n": r["n"], "mean": r["m"], "p_value": None, "equivalent": None}
    se = r["s"] / math.sqrt(r["n"])
    p = max(_t_tail((r["m"] + margin) / se, r["n"] - 1), 1 - _t_tail((r["m"] - margin) / se, r["n"] - 1))
    return {"n": r["n"], "mean": r["m"], "t_lower": (r["m"] + margin) / se, "t_upper": (r["m"] - margin) / se, "p_value": p, "equivalent": p < 0.05}
