"""Mixing documents to target domain weights, in DataFrame operations only.

A linear discriminant over the words that tell the labels' domains apart and a
few text measures is fitted from a labelled table by aggregates (the domains'
means and their common covariance) and gives each document soft memberships of
the domains. With tokens t, memberships p, all
tokens S and goals T, document rates r >= floor then solve the least squares

    min |(1/S) sum_i r_i t_i p_i - T|^2

by projected gradient steps from r = 1. The gradient of a rate is its
memberships times what is left of each domain, so a step moves every rate along
its own memberships only, and the projection is a floor. The steps are kept
before projection (r = max(floor, 1 + z . p) with z the sum of all steps, one
number for each domain), so that of all exact solutions the one with the least
change from 1 is found. Each iteration is one aggregate over the documents; it
gives what is left, and the curvature of the rates above the floor, which
scales the step. A step that does not lower the (dual) objective is halved.
Only numbers for each domain reach the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.exchange import free_name, other_columns, stored

MEASURES = ["m_chars", "m_word", "m_symbol", "m_line", "m_wide"]
#: Largest gap left between a goal and what is reached, as a share of all tokens, steps after which a warning is given, and what a budget chosen here has to spare.
TOLERANCE, ITERATIONS, SPARE = 1e-5, 60, 1.05
#: Bounds of the classifier: domains, labelled ids whose words are learned from, and words.
DOMAINS, TRAIN_ROWS, WORDS = 32, 12288, 256
#: Least labelled texts with a word, and what the covariance's diagonal gains.
LEAST_DOCS, RIDGE = 4, 0.01
#: Preference of each domain (quality and toxicity labels) over its share in the corpus, before normalising.
PREFERENCE = {"q1t0": 1.2}
OTHER_PREFERENCE = 0.9


def _let(value: Column, then) -> Column:
    """then(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[ \t-\r]+")


def _measures(text: Column) -> list[Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(t).cast("double")
    some = F.greatest(chars, F.lit(1.0))
    return [
        F.log1p(chars).alias("m_chars"),
        ((chars - F.length(F.replace(t, F.lit(" "), F.lit("")))) / some).alias("m_word"),
        F.log1p((chars - F.length(F.translate(t, "#*$%&|<>", ""))) * 1000 / some).alias("m_symbol"),
        ((chars - F.length(F.replace(t, F.lit("\n"), F.lit("")))) / some).alias("m_line"),
        ((F.octet_length(t) - chars) / some).alias("m_wide"),
    ]


def _domains(labels: DataFrame) -> DataFrame:
    """(_id, domain) for each labelled id; of several labels of one id the largest."""
    named = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    return named.select("_id", F.concat(F.lit("q"), F.col("q").cast("string"), F.lit("t"), F.col("x").cast("string")).alias("domain"))


def _sample(labels: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS labelled ids with their domains, spread by a hash of the id, to broadcast."""
    return F.broadcast(_domains(labels).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS))


def telling_words(docs: DataFrame, labels: DataFrame) -> list[str]:
    """The WORDS words of at most TRAIN_ROWS labelled ids whose presence tells most about the domain, by the likelihood ratio."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text")).join(_sample(labels), "_id")
    of_domain = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).limit(DOMAINS + 1).collect()}
    if len(of_domain) < 2:
        return []
    total = sum(of_domain.values())
    seen = rows.select("domain", F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).where("word <> ''")
    seen = seen.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(of_domain)]).where(f"n >= {LEAST_DOCS}")

    def part(seen_: Column, of: float, word: Column) -> Column:
        return F.when(seen_ > 0, seen_ * F.log(seen_ * F.lit(float(total)) / (F.lit(float(of)) * word))).otherwise(0.0)

    n = F.col("n").cast("double")
    g = F.lit(0.0)
    for i, of in enumerate(of_domain.values()):
        have = F.col(f"d{i}").cast("double")
        g = g + part(have, of, n) + part(F.lit(float(of)) - have, of, F.lit(float(total)) - n)
    best = seen.select("word", F.round(2 * g, 6).alias("g")).where("g >= 12").orderBy(F.desc("g"), "word").limit(WORDS)
    return sorted(r["word"] for r in best.collect())


def measured(docs: DataFrame, vocabulary: list[str], *more: Column) -> DataFrame:
    """(doc_id, tokens, has, measures, *more): has are the words of the vocabulary in the text, tokens its words."""
    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")

    def look(w: Column) -> Column:
        edges = (F.element_at(w, 1) == "").cast("int") + ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
        return F.struct((F.size(w) - edges).cast("double").alias("tokens"), F.array_intersect(w, known).alias("has"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _let(_words(F.col("text")), look).alias("w"), *_measures(F.col("text")), *more)
    return rows.select("doc_id", "w.tokens", "w.has", *[c for c in rows.columns if c not in ("doc_id", "w")])


def domain_model(rows: DataFrame, labels: DataFrame, vocabulary: list[str]) -> list[dict]:
    """Domains of the labelled sample, in name order, each with a constant and a weight for every word and measure; more than DOMAINS are an error."""
    named = rows.join(_sample(labels), rows.doc_id == F.col("_id")).drop("_id")
    got = named.groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in MEASURES], *[F.sum(F.col(c) * F.col(c)).alias(f"{c}_2") for c in MEASURES])
    got = {r["domain"]: r for r in got.orderBy(F.desc("n"), "domain").limit(DOMAINS + 1).collect()}
    if len(got) > DOMAINS:
        raise ValueError(f"the labels have more than {DOMAINS} domains")
    if not got:
        return []
    total, k = sum(r["n"] for r in got.values()), len(vocabulary)
    center = {c: sum(r[c] for r in got.values()) / total for c in MEASURES}
    spread = {c: math.sqrt(max(sum(r[f"{c}_2"] for r in got.values()) / total - center[c] ** 2, 1e-8)) for c in MEASURES}
    # a row as a sparse vector: its words, then its measures as deviates
    entry = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
    x = F.array(*[entry(F.lit(k + i), (F.col(c) - F.lit(center[c])) / F.lit(spread[c])) for i, c in enumerate(MEASURES)])
    if vocabulary:
        x = F.concat(F.transform("has", lambda w: entry(F.array_position(F.array(*map(F.lit, vocabulary)), w) - 1, F.lit(1.0))), x)
    sparse = stored(named.select("domain", x.alias("x")), "sparse")
    sums = {(r["domain"], r["i"]): r["v"] for r in sparse.select("domain", F.explode("x").alias("a")).groupBy("domain", F.col("a.i").alias("i")).agg(F.sum("a.v").alias("v")).collect()}
    pairs = sparse.select("x", F.explode("x").alias("a")).select("a", F.explode("x").alias("b")).where("a.i <= b.i").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.expr("a.v * b.v")).alias("v"))
    size = k + len(MEASURES)
    mean = {d: [sums.get((d, i), 0.0) / r["n"] for i in range(size)] for d, r in got.items()}
    within = [[-sum(r["n"] * mean[d][i] * mean[d][j] for d, r in got.items()) / total + (RIDGE if i == j else 0.0) for j in range(size)] for i in range(size)]
    for r in pairs.collect():  # at most (WORDS + measures) squared
        for i, j in {(r["i"], r["j"]), (r["j"], r["i"])}:
            within[i][j] += r["v"] / total
    names = sorted(got)
    weights = _solve(within, [[mean[d][i] for d in names] for i in range(size)])
    model = []
    for c, d in enumerate(names):
        w = [row[c] for row in weights]
        base = math.log(got[d]["n"] / total) - 0.5 * sum(a * b for a, b in zip(w, mean[d]))
        own = {m: w[k + i] / spread[m] for i, m in enumerate(MEASURES)}
        model.append({"domain": d, "base": base - sum(own[m] * center[m] for m in MEASURES), "words": w[:k]} | own)
    return model


def posterior(model: list[dict], vocabulary: list[str]) -> Column:
    """Memberships as an array in the model's order; with no model, one domain."""
    if not model:
        return F.array(F.lit(1.0))
    zero = F.array(*[F.lit(0.0) for _ in model])
    words = zero
    if vocabulary:
        table = F.create_map(*[x for i, w in enumerate(vocabulary) for x in (F.lit(w), F.array(*[F.lit(m["words"][i]) for m in model]))])
        words = F.aggregate("has", zero, lambda s, w: F.zip_with(s, F.element_at(table, w), lambda a, b: a + b))
    logs = []
    for m in model:
        x = F.lit(m["base"])
        for c in MEASURES:
            x = x + F.col(c) * F.lit(m[c])
        logs.append(x)
    scores = F.zip_with(words, F.array(*logs), lambda a, b: a + b)
    weights = _let(scores, lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))
    return _let(weights, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)))


def _solve(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """Gaussian elimination with pivots for the few words and domains; b and the result have a column for each right side."""
    n = len(b)
    m = [[*row, *right] for row, right in zip(a, b)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        top = m[i][i:]
        for r in range(i + 1, n):
            if m[r][i]:
                f = m[r][i] / top[0]
                m[r][i:] = [x - f * y for x, y in zip(m[r][i:], top)]
    for i in reversed(range(n)):
        right = m[i][n:]
        for c in range(i + 1, n):
            if m[i][c]:
                right = [x - m[i][c] * y for x, y in zip(right, m[c][n:])]
        m[i][n:] = [x / m[i][i] for x in right]
    return [row[n:] for row in m]


def _free(z: list[float]) -> Column:
    """The rates before projection."""
    r = F.lit(1.0)
    for d, v in enumerate(z):
        r = r + F.col("p")[d] * F.lit(v)
    return r


@dataclass
class Fit:
    """Steps' sum, goals and what is reached as shares of all tokens, iterations, and whether the goals are met or, where they cannot be, the least squares are."""

    z: list[float]
    goal: list[float]
    reached: list[float]
    iterations: int
    met: bool
    optimal: bool

    @property
    def gap(self) -> float:
        return max((abs(a - b) for a, b in zip(self.goal, self.reached)), default=0.0)


def solve_rates(members: DataFrame, targets: list[float] | None, budget: float | None, floor: float, preference: list[float]) -> Fit:
    """Rates over members(tokens, p) by projected gradient; a warning where the goals cannot be met or the steps ran out.

    Without a ``budget`` it is SPARE times the least one whose goals are not
    below what the floor alone gives any domain.

    The steps end when every goal is within TOLERANCE, or when no rate's own
    projected gradient, averaged over the tokens, is above TOLERANCE squared:
    then the goals cannot be met and this is the nearest that rates can come.
    """
    d = len(preference)
    tokens, p = F.col("tokens"), [F.col("p")[i] for i in range(d)]
    now = members.agg(F.sum("tokens").alias("s"), *[F.sum(tokens * p[i]).alias(f"t{i}") for i in range(d)]).first()
    total = now["s"] or 0.0
    if not total:
        return Fit([0.0] * d, [], [], 0, True, True)
    if targets is None:
        raw = [(now[f"t{i}"] or 0.0) * preference[i] for i in range(d)]
        targets = [x / sum(raw) for x in raw]
    if budget is None:
        budget = SPARE * max((floor * (now[f"t{i}"] or 0.0) / total / w for i, w in enumerate(targets) if w > 0), default=1.0)
    goal = [budget * w for w in targets]

    def look(z):
        """Dual objective, shares reached and curvature at z."""
        u = _free(z)
        r = F.greatest(F.lit(floor), u)
        dual = F.when(u > floor, u * u / 2).otherwise(u * floor - floor * floor / 2)
        above = F.when(u >= floor, tokens).otherwise(0.0)
        sums = [F.sum(tokens * dual).alias("f")] + [F.sum(tokens * p[i] * r).alias(f"t{i}") for i in range(d)]
        sums += [F.sum(above * p[i] * p[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        got = members.agg(*sums).first()
        curve = [[got[f"h{min(i, j)}_{max(i, j)}"] / total for j in range(d)] for i in range(d)]
        return got["f"] / total - sum(a * b for a, b in zip(z, goal)), [got[f"t{i}"] / total for i in range(d)], curve

    def left_over(z, gap):
        """Mean over the tokens of how far a gradient step of length 1 would move a rate; only rates that can move count."""
        u = _free(z)
        r = F.greatest(F.lit(floor), u)
        slope = F.lit(0.0)
        for i, g in enumerate(gap):
            slope = slope + p[i] * F.lit(g)
        return members.agg(F.sum(tokens * F.abs(F.greatest(F.lit(floor), r - slope) - r)).alias("m")).first()["m"] / total

    z, turn, damp = [0.0] * d, 0, 1e-6
    value, reached, curve = look(z)
    met = optimal = False
    while True:
        gap = [a - b for a, b in zip(reached, goal)]
        met = max(map(abs, gap)) < TOLERANCE
        optimal = met or (turn > 2 and left_over(z, gap) < TOLERANCE * max(map(abs, gap)))
        if optimal or turn == ITERATIONS:
            break
        scale = sum(curve[i][i] for i in range(d)) / d or 1.0
        step = _solve([[curve[i][j] + (damp * scale if i == j else 0.0) for j in range(d)] for i in range(d)], [[g] for g in gap])
        step = [x[0] for x in step]
        size, slope = 1.0, sum(a * b for a, b in zip(gap, step))
        while True:
            turn += 1
            trial = [a - size * b for a, b in zip(z, step)]
            found = look(trial)
            if found[0] <= value - 1e-4 * size * slope + 1e-13 * abs(value) or turn == ITERATIONS:
                break
            size /= 2
        z, (value, reached, curve) = trial, found
    if not met:
        why = "cannot be met" if optimal else f"are not met after {turn} iterations"
        warnings.warn(f"the goals {why}: shares of all tokens aimed at {[round(x, 5) for x in goal]}, reached {[round(x, 5) for x in reached]}", stacklevel=2)
    return Fit(z, goal, reached, turn, met, optimal)


def _fitted(docs: DataFrame, labels: DataFrame, targets, budget: float | None, floor: float, *more: Column):
    """(measured rows, posterior, domain names, fit)."""
    vocabulary = telling_words(docs, labels)
    rows = stored(measured(docs, vocabulary, *more), "measures")
    model = domain_model(rows, labels, vocabulary)
    names = [m["domain"] for m in model] or ["all"]
    p = posterior(model, vocabulary)
    members = stored(rows.select("doc_id", "tokens", p.alias("p")), "members")
    return rows, members, p, names, solve_rates(members, targets, budget, floor, [PREFERENCE.get(n, OTHER_PREFERENCE) for n in names])


def _copies(rate: Column) -> Column:
    unit = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + unit).cast("int")


def mix_to_targets(docs: DataFrame, labels: DataFrame, targets: list[float] | None = None, budget: float = 1.0, floor: float = 0.0) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate, copies, goal, reached, goals_met) for each row of ``docs``.

    ``targets`` are weights of the domains in name order (default: the
    corpus's own shares times PREFERENCE), ``budget`` is the expected tokens
    over the corpus's. goal and reached are the shares of the row's domain
    over all tokens of the corpus. copies rounds the rate by the document's
    own hash, so that its mean is the rate. Null and empty texts have 0 tokens
    and a rate like any other; without labels there is one domain and every
    rate is the budget's; repeated rows, and rows with null or equal ids, are
    mixed each; an empty table gives an empty table; other columns are not
    read.
    """
    _, members, _, names, fit = _fitted(docs, labels, targets, budget, floor)
    at = F.array_position("p", F.array_max("p")).cast("int")
    rated = members.withColumn("rate", F.greatest(F.lit(floor), _free(fit.z)))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at) if values else F.lit(0.0)
    return rated.select(
        "doc_id", F.col("tokens").cast("long").alias("n_tokens"), pick(names).alias("domain"), F.transform("p", lambda v: F.round(v, 6)).alias("posterior"),
        F.round("rate", 6).alias("rate"), _copies(F.col("rate")).alias("copies"), F.round(pick(fit.goal), 6).alias("goal"), F.round(pick(fit.reached), 6).alias("reached"), F.lit(fit.met).alias("goals_met"),
    )


def repeat_documents(docs: DataFrame, labels: DataFrame, budget: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies; rates are at least 1, so none is lost.

    Without a ``budget`` it is the least one at which such rates can meet the
    targets, and a little more.

    Each row is mixed by its own text, with a null or repeated id too. All
    columns travel with the measures, so none of their names can clash.
    """
    rest, kind = other_columns(docs)
    body = free_name()
    rows, _, p, _, fit = _fitted(docs, labels, None, budget, 1.0, rest, F.col("text").alias(body))
    rated = rows.select("rest", body, "doc_id", p.alias("p"))
    n = _copies(F.greatest(F.lit(1.0), _free(fit.z)))
    out = rated.select("rest", body, F.explode(F.sequence(F.lit(1), n)).alias(free_name()))
    return out.select(*[F.col(body).alias(c) if c.lower() == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
