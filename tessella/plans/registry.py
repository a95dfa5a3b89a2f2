"""Every query by name, and its SQL counterpart where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import expr as X
from tessella.functions import text as T
from tessella.operators import audit, cells, contrasts, inference, manifests, market, packets, render, selection
from tessella.sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = _no_negative_zero(sql)


def _no_negative_zero(sql: str) -> str:
    """round(...) + 0.0 for every round: Spark's has no negative zero."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"{sql[i:j]}(round({_no_negative_zero(sql[j + 6 : k - 1])}) + 0.0)")
        i = k
    return "".join(out) + sql[i:]


# -- common table expressions of the SQL side ---------------------------------------------------

DEC = """d AS (
  SELECT event_id AS row_number, event_id // 60 AS item, 'evt_' || (event_id // 60) AS event_id,
    CASE (event_id // 6) % 5 WHEN 0 THEN 'T1' WHEN 1 THEN 'B0' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' ELSE 'T4' END AS treatment_family,
    'm' || ((event_id // 30) % 2) AS model_family, 'p' || (event_id % 6) AS profile,
    CASE WHEN event_id % 6 < 3 THEN 'retail' ELSE 'institutional' END AS profile_group,
    CAST((CAST(floor(value * 100 + 0.5) AS BIGINT) % 4001) - 2000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS er,
    CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' WHEN event_type = 'error' THEN 'sell' ELSE 'hold' END AS action,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
e AS (
  SELECT *, list_sort(list_distinct(['S' || lpad(CAST(k % 7 AS VARCHAR), 3, '0'), 'S' || lpad(CAST((k // 7) % 7 AS VARCHAR), 3, '0'), 'X' || lpad(CAST(k % 3 AS VARCHAR), 3, '0')])) AS evidence,
    CASE action WHEN 'buy' THEN 1 WHEN 'hold' THEN 0 ELSE -1 END AS code FROM d)"""
OUT = """o AS (SELECT o_orderkey AS item, CAST(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 401 - 200 AS DOUBLE) / CAST(1000 AS DOUBLE) AS car FROM orders),
q AS (SELECT e.*, o.car, CASE WHEN er > 1e-12 THEN 1 WHEN er < -1e-12 THEN -1 ELSE 0 END AS es,
  CASE WHEN car > 1e-12 THEN 1 WHEN car < -1e-12 THEN -1 WHEN car IS NOT NULL THEN 0 END AS cs FROM e LEFT JOIN o ON o.item = e.item)"""
CELL = "event_id, treatment_family, model_family"
CELLS = f"""r AS (SELECT *, unnest(['all_profiles', profile_group]) AS investor_group FROM e),
m0 AS (SELECT {CELL}, investor_group, count(*) AS profile_count, avg(er) AS mean_er, stddev_pop(er) AS sd,
  quantile_cont(er, 0.75) - quantile_cont(er, 0.25) AS iqr, abs(avg(code)) AS net, list(DISTINCT profile) AS have,
  count(*) FILTER (action = 'buy') AS b, count(*) FILTER (action = 'hold') AS h, count(*) FILTER (action = 'sell') AS s FROM r GROUP BY ALL),
pr AS (SELECT x.{CELL.replace(', ', ', x.')}, x.investor_group, avg(abs(x.er - y.er)) AS mad FROM r x JOIN r y ON x.event_id = y.event_id
  AND x.treatment_family = y.treatment_family AND x.model_family = y.model_family AND x.investor_group = y.investor_group AND x.row_number < y.row_number GROUP BY ALL),
m1 AS (SELECT m0.*, pr.mad,
  -(CASE WHEN b > 0 THEN b * 1.0 / profile_count * log2(b * 1.0 / profile_count) ELSE 0 END + CASE WHEN h > 0 THEN h * 1.0 / profile_count * log2(h * 1.0 / profile_count) ELSE 0 END
    + CASE WHEN s > 0 THEN s * 1.0 / profile_count * log2(s * 1.0 / profile_count) ELSE 0 END) AS ent,
  (b * b + h * h + s * s) * 1.0 / (profile_count * profile_count) AS hhi FROM m0 LEFT JOIN pr USING ({CELL}, investor_group)),
cells AS (SELECT {CELL}, investor_group, profile_count, profile_count * (profile_count - 1) // 2 AS pair_count,
  profile_count = CASE WHEN investor_group = 'all_profiles' THEN 6 ELSE 3 END AS complete,
  CASE WHEN investor_group = 'all_profiles' THEN array_to_string(list_filter(['p0', 'p1', 'p2', 'p3', 'p4', 'p5'], lambda z: NOT list_contains(have, z)), ',') ELSE '' END AS missing_profiles,
  round(mean_er, 6) AS mean_er, round(sd, 6) AS er_sd, round(iqr, 6) AS er_iqr, round(mad, 6) AS belief_mad, round(ent, 6) AS action_entropy,
  round(hhi, 6) AS action_hhi, round(1 - hhi, 6) AS action_simpson, round(net, 6) AS net_direction, round(1 - net, 6) AS net_dispersion FROM m1)"""
W = f"WITH {DEC}"


def _dec(s, d):
    return A.decisions(s, d)


def _quality(s, d):
    return cells.with_quality(cells.with_outcomes(_dec(s, d), A.outcomes(s, d)))


def _cells(s, d):
    return cells.cell_metrics(_dec(s, d))


# -- cells --------------------------------------------------------------------------------------

_add("cell_metrics", _cells, f"{W}, {CELLS} SELECT * FROM cells")
_add("decision_codes", lambda s, d: contrasts.decision_codes(_dec(s, d)), f"{W} SELECT row_number, code, CASE WHEN er > 1e-12 THEN 1 WHEN er < -1e-12 THEN -1 ELSE 0 END AS er_sign, treatment_family AS family FROM e")
_PAIRS = f"""p AS (SELECT x.{CELL.replace(', ', ', x.')}, len(list_intersect(x.evidence, y.evidence)) * 1.0 / len(list_distinct(list_concat(x.evidence, y.evidence))) AS j
  FROM e x JOIN e y ON x.event_id = y.event_id AND x.treatment_family = y.treatment_family AND x.model_family = y.model_family AND x.row_number < y.row_number)"""
_add("set_metrics", lambda s, d: cells.set_metrics(_dec(s, d)), f"{W}, {_PAIRS} SELECT {CELL}, round(avg(j), 6) AS source_overlap, round(avg(1 - j), 6) AS source_distance FROM p GROUP BY ALL")
_IDX = "ix AS (SELECT * FROM (VALUES ('S000','revenue'),('S001','guidance'),('S002','margins'),('S003','risk'),('S004','cash'),('X000','revenue'),('X001','earnings')) v(source_id, category))"
_CATS = f"""ct AS (SELECT e.row_number, list_sort(list_distinct(list(ix.category) FILTER (ix.category IS NOT NULL))) AS cats, count(DISTINCT c.sid) AS cited, count(DISTINCT ix.source_id) AS mapped
  FROM e, LATERAL (SELECT unnest(e.evidence) AS sid) c LEFT JOIN ix ON ix.source_id = c.sid GROUP BY e.row_number)"""
_CATS = """ex AS (SELECT row_number, unnest(evidence) AS sid FROM e),
ct AS (SELECT ex.row_number, list_sort(coalesce(list_distinct(list(ix.category) FILTER (ix.category IS NOT NULL)), [])) AS cats, count(DISTINCT ex.sid) AS cited, count(DISTINCT ix.source_id) AS mapped FROM ex LEFT JOIN ix ON ix.source_id = ex.sid GROUP BY ex.row_number)"""
_add("evidence_categories", lambda s, d: cells.with_categories(_dec(s, d), A.source_categories(s)).select("row_number", F.array_join("categories", ",").alias("categories"), F.round("coverage", 6).alias("coverage")), f"{W}, {_IDX}, {_CATS} SELECT row_number, array_to_string(cats, ',') AS categories, round(mapped * 1.0 / cited, 6) AS coverage FROM ct")
_add("category_metrics", lambda s, d: cells.category_metrics(_dec(s, d), A.source_categories(s)), f"""{W}, {_IDX}, {_CATS},
c2 AS (SELECT e.*, ct.cats, ct.mapped * 1.0 / ct.cited AS cov FROM e JOIN ct USING (row_number)),
g AS (SELECT {CELL}, avg(cov) AS cov, bool_and(len(cats) > 0) AS ok FROM c2 GROUP BY ALL),
p AS (SELECT x.{CELL.replace(', ', ', x.')}, avg(CASE WHEN len(list_concat(x.cats, y.cats)) = 0 THEN 1.0 ELSE len(list_intersect(x.cats, y.cats)) * 1.0 / len(list_distinct(list_concat(x.cats, y.cats))) END) AS j
  FROM c2 x JOIN c2 y ON x.event_id = y.event_id AND x.treatment_family = y.treatment_family AND x.model_family = y.model_family AND x.row_number < y.row_number GROUP BY ALL)
SELECT {CELL}, round(cov, 6) AS coverage, CASE WHEN ok AND cov > 0 THEN round(j, 6) END AS category_overlap FROM g LEFT JOIN p USING ({CELL})""")
_add("quality_metrics", lambda s, d: cells.quality_metrics(_quality(s, d)), f"""{W}, {OUT} SELECT {CELL}, round(avg(CASE WHEN cs IS NOT NULL THEN CAST(es = cs AS INT) END), 6) AS directional_accuracy, round(avg(CASE WHEN cs IS NOT NULL THEN CAST(code = cs AS INT) END), 6) AS action_accuracy,
round(avg(er - car), 6) AS signed_error, round(avg(abs(er - car)), 6) AS absolute_error FROM q GROUP BY ALL""")
_add("metadata_join", lambda s, d: cells.with_metadata(_dec(s, d), A.metadata(s, d)).groupBy("sector", "market_cap_group", "event_metadata_joined").agg(F.count("*").alias("n")), f"""{W}, m AS (SELECT c_custkey AS item, c_mktsegment AS sector, CASE WHEN c_acctbal >= 5000 THEN 'large_cap' ELSE 'small_mid_cap' END AS market_cap_group FROM customer)
SELECT sector, market_cap_group, m.item IS NOT NULL AS event_metadata_joined, count(*) AS n FROM e LEFT JOIN m ON m.item = e.item GROUP BY ALL""")
_add("action_cells", lambda s, d: cells.action_cells(_dec(s, d)), f"""{W}, g AS (SELECT {CELL}, count(*) AS n, count(*) FILTER (action = 'buy') AS b, count(*) FILTER (action = 'hold') AS h, count(*) FILTER (action = 'sell') AS s, avg(confidence) AS c FROM e GROUP BY ALL)
SELECT {CELL}, n, b AS n_buy, h AS n_hold, s AS n_sell, round(b * 1.0 / n, 6) AS share_buy, round(h * 1.0 / n, 6) AS share_hold, round(s * 1.0 / n, 6) AS share_sell, round(1 - h * 1.0 / n, 6) AS trade_rate,
round(-(CASE WHEN b > 0 THEN b * 1.0 / n * log2(b * 1.0 / n) ELSE 0 END + CASE WHEN h > 0 THEN h * 1.0 / n * log2(h * 1.0 / n) ELSE 0 END + CASE WHEN s > 0 THEN s * 1.0 / n * log2(s * 1.0 / n) ELSE 0 END) / log2(3), 6) AS entropy_norm,
CASE WHEN n > 1 THEN round((b * (b - 1) + h * (h - 1) + s * (s - 1)) * 1.0 / (n * (n - 1)), 6) END AS same_share, round(c, 6) AS mean_confidence FROM g""")

_TEXTS = "t AS (SELECT item_id AS id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark)"
_FEATS = """f AS (SELECT id, 'w:' || w AS f FROM (SELECT id, unnest(string_split(t, ' ')) AS w FROM t) WHERE w <> ''
  UNION ALL SELECT id, 'c:' || substr(replace(t, ' ', '_'), CAST(i AS INT), 3) FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM t WHERE length(t) >= 3)),
tf AS (SELECT id, f, CAST(count(*) AS DOUBLE) AS c FROM f GROUP BY ALL), nm AS (SELECT id, sqrt(sum(c * c)) AS n FROM tf GROUP BY id)"""


def _benchmark(s, d):
    return A.table(s, d, "benchmark").select(F.lit("all").alias("grp"), F.col("item_id").alias("id"), "text")


_add("text_distance", lambda s, d: cells.lexical_distances(_benchmark(s, d)).select("a", "b", F.round("distance", 6).alias("distance")), f"""WITH {_TEXTS}, {_FEATS}
SELECT x.id AS a, y.id AS b, round(greatest(0.0, 1 - coalesce(dt.d, 0) / (x.n * y.n)), 6) AS distance FROM nm x JOIN nm y ON x.id < y.id
LEFT JOIN (SELECT p.id AS a, q.id AS b, sum(p.c * q.c) AS d FROM tf p JOIN tf q ON p.f = q.f AND p.id < q.id GROUP BY ALL) dt ON dt.a = x.id AND dt.b = y.id""")


def _reasoned(s, d):
    """Decisions with a benchmark text as rationale."""
    n = A.table(s, d, "benchmark").select(F.col("item_id").alias("text_no"), "text")
    return _dec(s, d).withColumn("text_no", F.col("row_number") % n.count()).join(n, "text_no", "left")


QUERIES["text_cells"] = lambda s, d: cells.text_cells(_reasoned(s, d))
ORACLE_SQL["text_cells"] = f"""{W}, {_TEXTS}, {_FEATS},
x AS (SELECT e.row_number, {CELL}, b.item_id AS id, b.text FROM e LEFT JOIN benchmark b ON b.item_id = e.row_number % (SELECT count(*) FROM benchmark)),
p AS (SELECT a.{CELL.replace(', ', ', a.')}, a.row_number AS r1, b.row_number AS r2, a.id AS i, b.id AS j FROM x a JOIN x b ON a.event_id = b.event_id AND a.treatment_family = b.treatment_family AND a.model_family = b.model_family AND a.row_number < b.row_number),
dt AS (SELECT u.id AS i, v.id AS j, sum(u.c * v.c) AS d FROM tf u JOIN tf v ON u.f = v.f GROUP BY ALL),
ds AS (SELECT {CELL}, avg(greatest(0.0, 1 - coalesce(dt.d, 0) / (m.n * k.n))) AS d FROM p JOIN nm m ON m.id = p.i JOIN nm k ON k.id = p.j LEFT JOIN dt ON dt.i = p.i AND dt.j = p.j GROUP BY ALL)
SELECT {CELL}, g.n, round(g.share, 6) AS nonempty_share, round(g.chars, 6) AS mean_chars, round(ds.d, 6) AS text_distance
FROM (SELECT {CELL}, count(*) AS n, avg(CAST(length(text) > 0 AS INT)) AS share, avg(length(text)) AS chars FROM x GROUP BY ALL HAVING count(*) > 1) g LEFT JOIN ds USING ({CELL})"""


def _vector_pairs(s, d):
    e = A.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return cells.pair_distances(e, "label", "v")


_add("vector_distance", _vector_pairs, """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label, count(*) AS pairs, round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS mean_distance, round(avg((1 - list_cosine_similarity(a.v, b.v)) / 2), 6) AS mean_normalised FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")

# -- contrasts and readouts -----------------------------------------------------------------------

_M = contrasts.METRICS
_K = "event_id, model_family, investor_group"
_add("contrasts_wide", lambda s, d: contrasts.contrasts_wide(_cells(s, d)), f"""{W}, {CELLS} SELECT {_K}, {", ".join(f"a.{m} AS {m}_T2, b.{m} AS {m}_T3, round(b.{m} - a.{m}, 6) AS {m}_delta, CASE WHEN b.{m} >= 1e-6 THEN round((b.{m} - a.{m}) / b.{m}, 6) END AS {m}_sci" for m in _M)}
FROM (SELECT * FROM cells WHERE treatment_family = 'T2') a JOIN (SELECT * FROM cells WHERE treatment_family = 'T3') b USING ({_K})""")
_LONG = f"l AS (SELECT {_K}, treatment_family AS f, unnest({_M!r}) AS metric, unnest([{', '.join(_M)}]) AS v FROM cells), lc AS (" + " UNION ALL ".join(
    f"SELECT {_K}, metric, '{n}' AS contrast, '{kind}' AS index_type, b.v AS baseline, c.v AS comparison, {'z.v' if z else 'CAST(NULL AS DOUBLE)'} AS denominator FROM (SELECT * FROM l WHERE f = '{b}') b JOIN (SELECT * FROM l WHERE f = '{c}') c USING ({_K}, metric)" + (f" LEFT JOIN (SELECT * FROM l WHERE f = '{z}') z USING ({_K}, metric)" if z else "")
    for n, b, c, z, kind in contrasts.CONTRASTS) + "), "
_LONG += """ll AS (SELECT *, CASE WHEN index_type = 'raw_delta' THEN NULL ELSE coalesce(abs(denominator) >= 1e-6, false) END AS stable, round(comparison - baseline, 6) AS delta FROM lc)"""
_add("contrasts_long", lambda s, d: contrasts.contrasts_long(_cells(s, d)), f"{W}, {CELLS}, {_LONG} SELECT {_K}, metric, contrast, index_type, baseline, comparison, delta, stable, CASE WHEN stable THEN round((comparison - baseline) / denominator, 6) END AS index_value FROM ll")
_add("contrast_means", lambda s, d: contrasts.contrast_means(contrasts.contrasts_long(_cells(s, d))), f"""{W}, {CELLS}, {_LONG} SELECT contrast, {", ".join(f"round(avg(delta) FILTER (metric = '{m}'), 6) AS {m}" for m in _M)} FROM ll WHERE investor_group = 'all_profiles' GROUP BY contrast""")
for _n, _g in (("treatment_means", ""), ("group_means", "investor_group"), ("model_means", "model_family")):
    _add(_n, lambda s, d, g=_g: contrasts.treatment_means(_cells(s, d), *([g] if g else [])), f"{W}, {CELLS} SELECT treatment_family{', ' + _g if _g else ''}, count(*) AS n_cells, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _M)} FROM cells GROUP BY ALL")
_BEH = """bh AS (SELECT treatment_family, profile, count(*) AS n, count(DISTINCT event_id) AS n_events, round(avg(CAST(action = 'buy' AS INT)), 6) AS share_buy, round(avg(CAST(action = 'hold' AS INT)), 6) AS share_hold, round(avg(CAST(action = 'sell' AS INT)), 6) AS share_sell,
round(avg(er), 6) AS mean_er, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN cs IS NOT NULL THEN CAST(es = cs AS INT) END), 6) AS directional_accuracy FROM q GROUP BY ALL)"""
_add("profile_behaviour", lambda s, d: contrasts.profile_behaviour(_quality(s, d)), f"{W}, {OUT}, {_BEH} SELECT * FROM bh")
_add("profile_contrasts", lambda s, d: contrasts.profile_contrasts(contrasts.profile_behaviour(_quality(s, d))), f"{W}, {OUT}, {_BEH} SELECT a.profile, a.treatment_family || '_minus_T1' AS contrast, {', '.join(f'round(a.{c} - b.{c}, 6) AS {c}' for c in ('share_buy', 'share_hold', 'share_sell', 'mean_er'))} FROM bh a JOIN bh b ON a.profile = b.profile AND b.treatment_family = 'T1' WHERE a.treatment_family <> 'T1'")
_add("transition_summary", lambda s, d: contrasts.transition_summary(contrasts.transitions(_dec(s, d), "T2", "T3")), f"""{W}, p AS (SELECT a.profile, a.action AS x, b.action AS y FROM e a JOIN e b USING (event_id, model_family, profile) WHERE a.treatment_family = 'T2' AND b.treatment_family = 'T3')
SELECT coalesce(profile, 'all') AS profile, count(*) AS n, {", ".join(f"round(avg(CAST({c} AS INT)), 6) AS {n}" for c, n in (("x = y", "same"), ("x <> y", "changed"), ("x = 'buy' AND y = 'hold'", "buy_to_hold"), ("x = 'sell' AND y = 'hold'", "sell_to_hold"), ("x = 'hold' AND y <> 'hold'", "hold_to_trade"), ("(x = 'buy' AND y = 'sell') OR (x = 'sell' AND y = 'buy')", "flip")))} FROM p GROUP BY ROLLUP (profile)""")


def _bundles(s, d):
    m = contrasts.treatment_means(_cells(s, d), "model_family")
    old, new = (m.where(c).drop("model_family", "n_cells") for c in ("model_family = 'm0' and treatment_family <> 'T4'", "model_family = 'm1' and treatment_family <> 'T1'"))
    return contrasts.side_by_side(old, new, ["treatment_family"], _M)


_add("side_by_side", _bundles, f"{W}, {CELLS}, g AS (SELECT treatment_family, model_family, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _M)} FROM cells GROUP BY ALL) SELECT treatment_family, {', '.join(f'a.{m} AS {m}_old, b.{m} AS {m}_new, round(b.{m} - a.{m}, 6) AS {m}_delta' for m in _M)} FROM (SELECT * FROM g WHERE model_family = 'm0' AND treatment_family <> 'T4') a FULL JOIN (SELECT * FROM g WHERE model_family = 'm1' AND treatment_family <> 'T1') b USING (treatment_family)")
_add("source_uptake", lambda s, d: contrasts.source_uptake(_dec(s, d)), f"""{W}, z AS (SELECT treatment_family, event_id, len(evidence) AS n, evidence FROM e), ev AS (SELECT treatment_family, event_id, avg(n) AS m FROM z GROUP BY ALL), u AS (SELECT treatment_family, count(DISTINCT x) AS c FROM (SELECT treatment_family, unnest(evidence) AS x FROM z) GROUP BY ALL)
SELECT treatment_family, round(avg(n), 6) AS mean_sources, median(n) AS median_sources, any_value(u.c) AS distinct_sources, any_value(em.m) AS event_mean_sources FROM z JOIN u USING (treatment_family) JOIN (SELECT treatment_family, round(avg(m), 6) AS m FROM ev GROUP BY ALL) em USING (treatment_family) GROUP BY treatment_family""")
_add("positive_share", lambda s, d: contrasts.positive_share(_dec(s, d)), f"{W} SELECT event_id, treatment_family, round(avg(CAST(coalesce(er > 0, false) AS INT)), 6) AS p_plus, round(avg(er), 6) AS mean_er, round(avg(CAST(action = 'buy' AS INT)), 6) AS buy_rate FROM e GROUP BY ALL")
_add("separability", lambda s, d: contrasts.separability(_dec(s, d)), f"{W} SELECT a.treatment_family, a.profile AS p, b.profile AS q, count(*) AS n, round(avg(b.er - a.er), 6) AS delta FROM e a JOIN e b USING ({CELL}) WHERE a.profile < b.profile GROUP BY a.treatment_family, a.profile, b.profile".replace("SELECT a.treatment_family", "SELECT treatment_family").replace("GROUP BY a.treatment_family", "GROUP BY treatment_family"))
_add("conditional_positive", lambda s, d: contrasts.conditional_positive(_quality(s, d)), f"{W}, {OUT} SELECT treatment, CASE WHEN car > 0 THEN 'positive' WHEN car < 0 THEN 'negative' ELSE 'zero' END AS outcome, count(*) AS n, round(avg(CAST(er > 0 AS INT)), 6) AS positive_rate FROM (SELECT *, unnest([treatment_family, 'pooled']) AS treatment FROM q WHERE car IS NOT NULL) GROUP BY ALL")
_add("group_summary", lambda s, d: contrasts.group_summary(_dec(s, d), "model_family", ["er", "confidence"]), f"{W} SELECT model_family, count(*) AS n, {', '.join(f'round(avg({v}), 6) AS {v}_mean, round(median({v}), 6) AS {v}_median, round(avg(CAST({v} > 0 AS INT)), 6) AS {v}_positive' for v in ('er', 'confidence'))} FROM e GROUP BY ALL")

# -- upstream compression -------------------------------------------------------------------------


def _upstream(s, d):
    """Conversations as representations: a user turn is the shared one, assistant turns are by profile; sources are turn words with digits."""
    c = A.table(s, d, "conversations")
    return c.select("conv_id", "turn", "role", X.token_count(F.col("text")).alias("n_tokens"), F.sort_array(F.array_distinct(F.transform(F.array(F.length("text") % 5, F.length("text") % 7, F.length("text") % 11), lambda v: F.concat(F.lit("S"), F.lpad(v.cast("string"), 3, "0"))))).alias("cited"))


_UP = r"""u AS (SELECT conv_id, turn, role, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._%/-][A-Za-z0-9]+)*')) AS n_tokens,
list_sort(list_distinct(['S' || lpad(CAST(length(text) % 5 AS VARCHAR), 3, '0'), 'S' || lpad(CAST(length(text) % 7 AS VARCHAR), 3, '0'), 'S' || lpad(CAST(length(text) % 11 AS VARCHAR), 3, '0')])) AS cited FROM conversations)"""
_add("upstream_rows", lambda s, d: _upstream(s, d).select("conv_id", "turn", "role", "n_tokens", F.size("cited").alias("n_cited"), F.size(F.array_except("cited", F.array(*[F.lit(f"S00{i}") for i in range(6)]))).alias("n_invalid"), F.round(F.size(F.array_intersect("cited", F.array(*[F.lit(f"S00{i}") for i in range(6)]))) / 6, 6).alias("coverage"), F.round(1 - F.col("n_tokens") / F.lit(400.0), 6).alias("compression")),
     f"WITH {_UP} SELECT conv_id, turn, role, n_tokens, len(cited) AS n_cited, len(list_filter(cited, lambda x: x > 'S005')) AS n_invalid, round(len(list_filter(cited, lambda x: x <= 'S005')) / 6.0, 6) AS coverage, round(1 - n_tokens / 400.0, 6) AS compression FROM u")


def _upstream_cells(s, d):
    u = _upstream(s, d).withColumn("n", F.size("cited").cast("double"))
    t2 = u.where("role = 'user'").groupBy("conv_id").agg(F.min_by("n", "turn").alias("shared"))
    t3 = u.where("role = 'assistant'").groupBy("conv_id").agg(F.avg("n").alias("mean"), F.size(F.array_distinct(F.flatten(F.collect_list("cited")))).cast("double").alias("all"))
    return t2.join(t3, "conv_id").select("conv_id", "shared", F.round("mean", 6).alias("profile_mean"), F.col("all").alias("profile_union"), F.round((F.col("all") - F.col("shared")) / F.col("all"), 6).alias("rbi"))


_add("upstream_cells", _upstream_cells, f"""WITH {_UP}, a AS (SELECT conv_id, CAST(arg_min(len(cited), turn) AS DOUBLE) AS shared FROM u WHERE role = 'user' GROUP BY ALL), b AS (SELECT conv_id, avg(len(cited)) AS m, CAST(len(list_distinct(flatten(list(cited)))) AS DOUBLE) AS z FROM u WHERE role = 'assistant' GROUP BY ALL)
SELECT conv_id, shared, round(m, 6) AS profile_mean, z AS profile_union, round((z - shared) / z, 6) AS rbi FROM a JOIN b USING (conv_id)""")

# -- inference --------------------------------------------------------------------------------------

_DEL = "dl AS (SELECT event_id, avg(er) FILTER (treatment_family = 'T3') - avg(er) FILTER (treatment_family = 'T2') AS delta FROM e GROUP BY event_id HAVING delta IS NOT NULL)"


def _deltas(s, d):
    return inference.event_deltas(_dec(s, d), "T2", "T3")


_add("event_deltas", lambda s, d: _deltas(s, d).select("event_id", F.round("delta", 6).alias("delta")), f"{W}, {_DEL} SELECT event_id, round(delta, 6) AS delta FROM dl")
_add("event_bootstrap", lambda s, d: inference.bootstrap(_deltas(s, d)), f"""{W}, {_DEL}, v AS (SELECT delta, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM dl),
sl AS (SELECT rep, slot, n FROM (SELECT DISTINCT n FROM v), (SELECT unnest(range(20000)) AS rep), (SELECT i AS slot FROM v)),
mu AS (SELECT rep, avg(v.delta) AS mu FROM sl JOIN v ON v.i = CAST('0x' || substr(md5(rep || ':' || slot), 1, 12) AS BIGINT) % sl.n GROUP BY rep),
ci AS (SELECT round(quantile_cont(mu, 0.025), 6) AS ci_low, round(quantile_cont(mu, 0.975), 6) AS ci_high, least(avg(CAST(mu <= 0 AS INT)), avg(CAST(mu >= 0 AS INT))) AS t FROM mu)
SELECT count(*) AS n_events, round(avg(delta), 6) AS mean_delta, round(median(delta), 6) AS median_delta, round(avg(CAST(delta > 0 AS INT)), 6) AS positive_share, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high, round(2 * any_value(t), 6) AS p_unclipped, round(least(1.0, 2 * any_value(t)), 6) AS p_value FROM dl, ci""")
_add("sign_test", lambda s, d: inference.sign_test(_deltas(s, d)), f"""{W}, {_DEL}, c AS (SELECT count(*) FILTER (delta > 1e-12) AS plus, count(*) FILTER (delta < -1e-12) AS minus FROM dl),
tl AS (SELECT sum(exp(lgamma(plus + minus + 1) - lgamma(i + 1) - lgamma(plus + minus - i + 1) - (plus + minus) * ln(2.0))) AS s FROM c, (SELECT unnest(range(100000)) AS i) WHERE i <= least(plus, minus))
SELECT plus, minus, round(least(1.0, 2 * s), 6) AS p_value FROM c, tl""")


def _few(s, d):
    """Twelve pairs: T3 minus T2 of each profile under each model, over all rows."""
    units = _dec(s, d).withColumn("event_id", F.concat_ws("|", "profile", "model_family"))
    return inference.event_deltas(units, "T2", "T3")


_add("sign_flip_exact", lambda s, d: inference.sign_flip(_few(s, d)), f"""{W}, dl AS (SELECT profile || '|' || model_family AS event_id, avg(er) FILTER (treatment_family = 'T3') - avg(er) FILTER (treatment_family = 'T2') AS delta FROM e GROUP BY 1 HAVING delta IS NOT NULL),
v AS (SELECT delta, row_number() OVER (ORDER BY event_id) - 1 AS i FROM dl),
f AS (SELECT b, sum(CASE WHEN (b >> CAST(i AS INT)) & 1 = 1 THEN -delta ELSE delta END) AS s FROM v, (SELECT unnest(range(4096)) AS b) GROUP BY b)
SELECT count(*) AS permutations, round(avg(CAST(abs(s) >= abs((SELECT sum(delta) FROM v)) - 1e-12 AS INT)), 6) AS p_value FROM f WHERE b < (SELECT 1 << count(*)::INT FROM v)""")
_add("sign_flip_monte_carlo", lambda s, d: inference.monte_carlo_sign_flip(_deltas(s, d), 500), f"""{W}, {_DEL}, f AS (SELECT rep, sum(CASE WHEN CAST('0x' || substr(md5(rep || ':' || event_id), 1, 1) AS BIGINT) % 2 = 1 THEN -delta ELSE delta END) AS s FROM dl, (SELECT unnest(range(500)) AS rep) GROUP BY rep)
SELECT count(*) AS draws, round((count(*) FILTER (abs(s) >= abs((SELECT sum(delta) FROM dl)) - 1e-12) + 1) * 1.0 / (count(*) + 1), 6) AS p_value FROM f""")


def _p_values(s, d):
    x = A.table(s, d, "part").select("p_partkey", "p_brand", ((F.floor(F.col("p_retailprice") * 100 + 0.5).cast("bigint") % 1000).cast("double") / F.lit(1000.0)).alias("p_value"))
    return inference.benjamini_hochberg(x, ["p_brand"], "p_partkey").withColumn("q_value", F.round("q_value", 6))


_add("bh_fdr", _p_values, """WITH t AS (SELECT p_partkey, p_brand, CAST(CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) % 1000 AS DOUBLE) / 1000.0 AS p_value FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_value, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS m FROM t)
SELECT p_partkey, p_brand, p_value, round(least(1.0, min(p_value * m / k) OVER (PARTITION BY p_brand ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM r""")
_add("spearman", lambda s, d: inference.spearman(_cells(s, d).where("investor_group = 'all_profiles'"), ["treatment_family"], "belief_mad", "action_entropy"), f"""{W}, {CELLS}, z AS (SELECT treatment_family, belief_mad AS x, action_entropy AS y FROM cells WHERE investor_group = 'all_profiles' AND belief_mad IS NOT NULL AND action_entropy IS NOT NULL),
k AS (SELECT treatment_family, rank() OVER (PARTITION BY treatment_family ORDER BY x) + (count(*) OVER (PARTITION BY treatment_family, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY treatment_family ORDER BY y) + (count(*) OVER (PARTITION BY treatment_family, y) - 1) / 2.0 AS ry FROM z)
SELECT treatment_family, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY ALL HAVING count(*) >= 3""")
_add("numpy_bootstrap", lambda s, d: inference.numpy_bootstrap(_deltas(s, d).withColumn("test", F.lit("T3_minus_T2")), "test", "delta", 2000))
_add("equivalence_test", lambda s, d: s.createDataFrame([{k: (float(v) if isinstance(v, float) else v) for k, v in inference.equivalence(_deltas(s, d)).items()}]))

# -- market -------------------------------------------------------------------------------------------

_MK = """px AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, avg(value) AS price FROM events GROUP BY ALL), mk AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mp FROM events GROUP BY ALL),
rt AS (SELECT ticker, day, price, mp, row_number() OVER w AS loc, count(*) OVER (PARTITION BY ticker) AS days, price / lag(price) OVER w - 1 AS ret, mp / lag(mp) OVER w - 1 AS mret FROM px JOIN mk USING (day) WINDOW w AS (PARTITION BY ticker ORDER BY day)),
ac AS (SELECT user_id AS ticker, max(ts) AS accepted_at FROM events WHERE ts < TIMESTAMP '2024-01-25' GROUP BY ALL),
t0 AS (SELECT ac.ticker, accepted_at, strftime(accepted_at, '%H:%M:%S') > '16:00:00' AS after_close, min(px.day) AS t0 FROM ac LEFT JOIN px ON px.ticker = ac.ticker AND (px.day > CAST(accepted_at AS DATE) OR (px.day = CAST(accepted_at AS DATE) AND NOT strftime(accepted_at, '%H:%M:%S') > '16:00:00')) GROUP BY ALL)"""


def _market(s, d):
    return A.accepted(s, d), A.prices(s, d), A.market(s, d)


_add("reaction_days", lambda s, d: market.reaction_days(*_market(s, d)[:2]).select("ticker", "after_close", "t0"), f"WITH {_MK} SELECT ticker, after_close, t0 FROM t0")
_add("event_outcomes", lambda s, d: market.event_outcomes(*_market(s, d)), f"""WITH {_MK}, w AS (SELECT ticker, day AS t0, loc, days, sum(ret - mret) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS car,
lag(price, 1) OVER v / lag(price, 6) OVER v - 1 AS r5, lag(price, 1) OVER v / lag(price, 21) OVER v - 1 AS r20, lag(mp, 1) OVER v / lag(mp, 21) OVER v - 1 AS m20 FROM rt WINDOW v AS (PARTITION BY ticker ORDER BY day)),
x AS (SELECT t0.ticker, t0.t0, after_close, CASE WHEN t0.t0 IS NULL THEN 'no_trading_day_on_or_after_event' WHEN loc <= 21 THEN 'not_enough_pre_event_history' WHEN loc + 5 > days THEN 'not_enough_post_event_history' END AS error, car, r5, r20, m20 FROM t0 LEFT JOIN w USING (ticker, t0))
SELECT ticker, t0, after_close, error, CASE WHEN error IS NULL THEN round(r5, 6) END AS ret_5d, CASE WHEN error IS NULL THEN round(r20, 6) END AS ret_20d, CASE WHEN error IS NULL THEN round(m20, 6) END AS market_ret_20d, CASE WHEN error IS NULL THEN round(car, 6) END AS car,
CASE WHEN error IS NULL THEN CASE WHEN car > 0.03 THEN 'positive' WHEN car < -0.03 THEN 'negative' ELSE 'mixed' END END AS valence FROM x""")
_add("abnormal_windows", lambda s, d: market.abnormal_windows(*_market(s, d)[1:]), f"WITH {_MK} SELECT ticker, day, loc, {', '.join(f'CASE WHEN loc + {h} <= days THEN round(sum(ret - mret) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 6) END AS car_{h}' for h in (5, 20))} FROM rt")

# -- selection -----------------------------------------------------------------------------------------

_FIL = "fl AS (SELECT o_orderkey AS accession, o_custkey AS issuer, n_regionkey AS cap_group, c_mktsegment AS sector, o_orderdate AS accepted_at, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_orderstatus AS status, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_ONE = "one AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY cap_group, issuer ORDER BY accepted_at DESC NULLS LAST, tokens DESC NULLS LAST, abs(balance) DESC NULLS LAST, accession) = 1)"
_add("one_per_issuer", lambda s, d: selection.one_per_issuer(A.filings(s, d)).select("cap_group", "issuer", "accession", "tokens"), f"WITH {_FIL}, {_ONE} SELECT cap_group, issuer, accession, tokens FROM one")
_add("top_of_group", lambda s, d: selection.top_of_group(selection.one_per_issuer(A.filings(s, d)), 20).select("cap_group", "accession", "pick"), f"WITH {_FIL}, {_ONE} SELECT cap_group, accession, pick FROM (SELECT *, row_number() OVER (PARTITION BY cap_group ORDER BY sector, accepted_at DESC, tokens DESC, abs(balance) DESC, accession) AS pick FROM one) WHERE pick <= 20")


def _spread_sql(part: str, quota: str, n: int, pre: str = "") -> str:
    return f"""WITH {_FIL}{pre}, a AS (SELECT *, row_number() OVER (PARTITION BY cap_group, {part} ORDER BY accepted_at DESC, accession) AS r, {quota} AS q FROM {'fx' if pre else 'fl'}),
b AS (SELECT *, row_number() OVER (PARTITION BY cap_group ORDER BY CAST(r > q AS INT), accepted_at DESC, accession) AS pick FROM a) SELECT cap_group, accession, pick FROM b WHERE pick <= {n}"""


_add("diverse_pick", lambda s, d: selection.diverse(A.filings(s, d), 1000).select("cap_group", "accession", "pick"), _spread_sql("issuer", "greatest(1, ceil(1000.0 / c))", 1000, ", fx AS (SELECT fl.*, c FROM fl JOIN (SELECT cap_group, count(DISTINCT issuer) AS c FROM fl GROUP BY 1) USING (cap_group))"))
_add("time_balanced_pick", lambda s, d: selection.time_balanced(A.filings(s, d), 100).select("cap_group", "accession", "pick"), _spread_sql("year(accepted_at)", "floor(100.0 / c)", 100, ", fx AS (SELECT fl.*, c FROM fl JOIN (SELECT cap_group, count(DISTINCT year(accepted_at)) AS c FROM fl GROUP BY 1) USING (cap_group))"))
_add("sector_balanced_pick", lambda s, d: selection.sector_balanced(A.filings(s, d), 103).select("cap_group", "accession", "pick"), _spread_sql("sector", "floor(103.0 / c) + CASE WHEN k <= 103 % c THEN 1 ELSE 0 END", 103, ", fx AS (SELECT fl.*, c, k FROM fl JOIN (SELECT cap_group, sector, row_number() OVER (PARTITION BY cap_group ORDER BY sector) AS k, count(*) OVER (PARTITION BY cap_group) AS c FROM (SELECT DISTINCT cap_group, sector FROM fl)) USING (cap_group, sector))"))


def _rules():
    return {"status_open": F.col("status") != "F", "too_short": F.col("tokens") >= 50000, "negative_balance": F.col("balance") >= 0}


_add("eligibility_reasons", lambda s, d: A.filings(s, d).select("accession", selection.eligibility_reasons(_rules()).alias("reasons")), f"WITH {_FIL} SELECT accession, concat_ws(';', CASE WHEN NOT coalesce(status <> 'F', false) THEN 'status_open' END, CASE WHEN NOT coalesce(tokens >= 50000, false) THEN 'too_short' END, CASE WHEN NOT coalesce(balance >= 0, false) THEN 'negative_balance' END) AS reasons FROM fl")

# -- text, audits, manifests -------------------------------------------------------------------------


def _docs(s, d):
    return A.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_DOC = "dc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_add("text_measures", lambda s, d: _docs(s, d).select("doc_id", X.token_count(F.col("text")).alias("n_tokens"), F.ceil(F.length("text") / 4).alias("rough_tokens"), F.sha2(X.truncated(X.folded(F.col("text")), 80).cast("binary"), 256).alias("head_sha256")), rf"WITH {_DOC}, x AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS f FROM dc) SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[._%/-][A-Za-z0-9]+)*')) AS n_tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS rough_tokens, sha256(CASE WHEN length(f) > 80 THEN rtrim(substr(f, 1, 77)) || '...' ELSE f END) AS head_sha256 FROM x")
_add("leakage_scan", lambda s, d: audit.leakage_scan(_docs(s, d)), f"WITH {_DOC}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, '{v}' AS severity, len(regexp_extract_all(text, '{p}')) AS n, regexp_extract(text, '{p}') AS first_match FROM dc" for n, (v, p) in audit.LEAKAGE.items()) + ") SELECT * FROM h WHERE n > 0")
_add("leakage_summary", lambda s, d: audit.leakage_summary(audit.leakage_scan(_docs(s, d))), f"WITH {_DOC}, h AS (" + " UNION ALL ".join(f"SELECT doc_id, {audit.SEVERITY[v]} AS r FROM dc WHERE regexp_matches(text, '{p}')" for v, p in audit.LEAKAGE.values()) + ") SELECT risk, count(*) AS n_records FROM (SELECT doc_id, max(r) AS risk FROM h GROUP BY 1) GROUP BY 1")
_add("masking_findings", lambda s, d: audit.masking_findings(_docs(s, d)))
_add("masking_summary", lambda s, d: audit.leakage_summary(audit.masking_findings(_docs(s, d))))
_add("validation_report", lambda s, d: audit.validation_report(_dec(s, d), F.array(*[F.lit(f"S00{i}") for i in range(6)], *[F.lit(f"X00{i}") for i in range(3)])), f"""{W}, v AS (SELECT 'expected_return_5d' AS field, 'missing' AS code FROM e WHERE er IS NULL UNION ALL SELECT 'expected_return_5d', 'out_of_range' FROM e WHERE abs(er) > 0.15 UNION ALL SELECT 'confidence', 'out_of_range' FROM e WHERE NOT confidence BETWEEN 0.05 AND 0.95
UNION ALL SELECT 'evidence_used', 'too_few_items' FROM e WHERE len(evidence) < 3 UNION ALL SELECT 'action', 'sign_mismatch' FROM e WHERE action = 'buy' AND er < 0 UNION ALL SELECT 'evidence_used', 'unknown_source_id' FROM e WHERE list_contains(evidence, 'S006')) SELECT field, code, count(*) AS n FROM v GROUP BY ALL""")
_add("json_fields", lambda s, d: audit.json_fields(A.table(s, d, "events"), "event_id", "props").groupBy("path", "value").agg(F.count("*").alias("n")), "SELECT '$.' || k AS path, json_extract_string(props, '$.' || k) AS value, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
_add("hash_shards", lambda s, d: _dec(s, d).groupBy(X.hash_shard(F.concat_ws("|", "event_id", "treatment_family", "profile"), 8).alias("shard")).agg(F.count("*").alias("n")), f"{W} SELECT CAST(CAST('0x' || substr(sha256(event_id || '|' || treatment_family || '|' || profile), 1, 16) AS UBIGINT) % 8 AS INT) AS shard, count(*) AS n FROM e GROUP BY ALL")
_add("business_days", lambda s, d: A.table(s, d, "events").select(F.to_date("ts").alias("day")).distinct().select("day", X.next_business_day(F.col("day")).alias("next_day")), "SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) + CAST(CASE dayofweek(ts) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) AS DATE) AS next_day FROM events")
_add("duplicate_identities", lambda s, d: audit.duplicate_identities(A.table(s, d, "lineitem"), ["l_orderkey", "l_suppkey"]), "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
_add("last_of_key", lambda s, d: audit.last_of_key(A.table(s, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role"), "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
_add("resume_anti_join", lambda s, d: audit.remaining(A.table(s, d, "orders"), A.table(s, d, "lineitem").where("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")


def _compared(s, d):
    c = A.table(s, d, "conversations")
    bank, shown = c.where("turn < 5").select("conv_id", "turn", "role"), c.where("turn > 0").select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, "other").otherwise(F.col("role")).alias("role"))
    return audit.compare_units(bank, shown, ["conv_id", "turn"], ["role"]).groupBy("status").agg(F.count("*").alias("n"))


_add("unit_comparison", _compared, """WITH b AS (SELECT conv_id, turn, role FROM conversations WHERE turn < 5), r AS (SELECT conv_id, turn, any_value(CASE WHEN conv_id % 7 = 0 THEN 'other' ELSE role END) AS rr, count(*) AS c FROM conversations WHERE turn > 0 GROUP BY ALL)
SELECT CASE WHEN c IS NULL THEN 'missing' WHEN role IS NULL THEN 'extra' WHEN c > 1 THEN 'duplicate' WHEN role <> rr THEN 'mismatch' ELSE 'equal' END AS status, count(*) AS n FROM b FULL JOIN r USING (conv_id, turn) GROUP BY ALL""")
_add("manifest_freeze", lambda s, d: audit.frozen(A.table(s, d, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]), """WITH j AS (SELECT n_nationkey, CAST('0x' || substr(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'), 1, 12) AS BIGINT) AS p FROM nation)
SELECT count(*) AS n_rows, count(DISTINCT n_nationkey) AS n_keys, CAST(sum(p) % (1::BIGINT << 48) AS BIGINT) AS digest FROM j""")
_add("ledger_render", lambda s, d: render.ledger_text(A.table(s, d, "conversations"), "conv_id", "turn", F.concat(F.lit("- "), "role", F.lit(": "), "text")).drop("rendered_text"), "SELECT conv_id, CAST(count(*) AS INT) AS n_units, sha256(string_agg('- ' || role || ': ' || text, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id")
_AXES = {"model": ["a", "b"], "profile": ["p0", "p1", "p2"], "seed": [1, 2]}
_add("request_expansion", lambda s, d: render.expand(A.table(s, d, "benchmark").select("item_id"), _AXES), "SELECT item_id, model, profile, seed, item_id || '|' || model || '|' || profile || '|' || seed AS request_key FROM benchmark, (SELECT unnest(['a', 'b']) AS model), (SELECT unnest(['p0', 'p1', 'p2']) AS profile), (SELECT unnest([1, 2]) AS seed)")
_U = lambda i: f"CAST(CAST('0x' || substr(sha256(request_key), {i}, 8) AS BIGINT) AS DOUBLE) / 4294967295.0"
_add("mock_decisions", lambda s, d: render.mock_decisions(A.table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("request_key"))).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence")), f"""WITH r AS (SELECT 'o' || o_orderkey AS request_key FROM orders), x AS (SELECT ({_U(1)} * 2 - 1) * 0.06 AS s, round(0.4 + 0.5 * {_U(9)}, 4) AS c FROM r)
SELECT CASE WHEN s > 0.018 THEN 'buy' WHEN s < -0.018 THEN 'sell' ELSE 'hold' END AS action, count(*) AS n, round(avg(c), 5) AS mean_confidence FROM x GROUP BY ALL""")
_add("evidence_permutation", lambda s, d: render.permuted(A.table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "t6"), """WITH a AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS old_index, row_number() OVER (PARTITION BY conv_id ORDER BY sha256('t6|' || conv_id || '|' || turn)) - 1 AS n FROM conversations),
b AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c, min(CAST(old_index = n AS INT)) OVER (PARTITION BY conv_id) AS same FROM a) SELECT conv_id, turn, old_index, CAST(CASE WHEN same = 1 AND c > 1 THEN (n + 1) % c ELSE n END AS INT) AS new_index FROM b""")
_add("evidence_bank", lambda s, d: render.evidence_bank(_docs(s, d)).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents"), F.max("pos").alias("last_position")))
_add("html_text", lambda s, d: A.table(s, d, "pages").select("page_id", F.length(T.html_to_text(F.coalesce("html", F.lit("")))).alias("n_chars"), T.looks_like_heading(F.col("url")).alias("heading")))
_add("paragraphs", lambda s, d: _docs(s, d).select("doc_id", F.size(T.packed_paragraphs(F.col("text"))).alias("n_paragraphs"), F.size(T.sentences(F.col("text"))).alias("n_sentences"), X.first_sentence(F.col("text")).alias("first_sentence"), F.size(T.protected_tokens(F.col("text"))).alias("n_protected")))

# -- packets and edit manifests ----------------------------------------------------------------------

_NAMES = ["first", "second", "third", "fourth"]


def _period_text():
    """A results headline for each order, in one of five forms."""
    k, year = F.col("o_orderkey"), (2000 + F.col("o_orderkey") % 100).cast("string")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 4 + 1).cast("int"))
    month = F.element_at(F.array(*map(F.lit, ["March", "June", "Sep", "December"])), (k % 4 + 1).cast("int"))
    forms = [F.concat(F.lit("Results of the "), F.initcap(name), F.lit(" quarter of "), year), F.concat(F.lit("In "), year, F.lit(" Q"), (k % 4 + 1).cast("string"), F.lit(" quarter")), F.concat(F.lit("Three months ended "), month, F.lit(" 30, "), year), F.concat(F.lit("the full year "), year), F.lit("quarter ended May 31, 2020")]
    return F.element_at(F.array(*forms), (F.floor(k / 4) % 5 + 1).cast("int"))


_add("fiscal_period", lambda s, d: A.table(s, d, "orders").select("o_orderkey", packets.fiscal_period(_period_text()).alias("fiscal_period")), "SELECT o_orderkey, CASE WHEN (o_orderkey // 4) % 5 < 3 THEN 'FY' || (2000 + o_orderkey % 100) || ' Q' || (o_orderkey % 4 + 1) WHEN (o_orderkey // 4) % 5 = 3 THEN 'FY' || (2000 + o_orderkey % 100) END AS fiscal_period FROM orders")


def _facts(s, d):
    """Line items as filed facts of their order, with a cut-off sixty days after it."""
    o = A.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_add(F.to_date("o_orderdate"), 60).alias("cutoff"), F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string")).alias("target"))
    day = F.to_date("l_shipdate")
    f = A.table(s, d, "lineitem").select("l_orderkey", day.alias("filed"), F.last_day(F.date_sub(day, 30)).alias("end"), F.year(day).alias("fy"), F.when(F.col("l_suppkey") % 3 == 0, "FY").otherwise(F.concat(F.lit("Q"), F.quarter(day).cast("string"))).alias("fp"), (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("ordinal"))
    return f.join(o, "l_orderkey")


_FCT = """f AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS filed, last_day(CAST(l_shipdate AS DATE) - 30) AS ended, year(l_shipdate) AS fy, CASE WHEN l_suppkey % 3 = 0 THEN 'FY' ELSE 'Q' || quarter(l_shipdate) END AS fp, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS ordinal,
  CAST(o_orderdate AS DATE) + 60 AS cutoff, year(o_orderdate) AS y, 'Q' || quarter(o_orderdate) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + 60)"""
_add("chosen_facts", lambda s, d: packets.chosen_facts(_facts(s, d), ["l_orderkey"], "cutoff", "target").select("l_orderkey", "filed", "fp", "ordinal"), f"WITH {_FCT} SELECT l_orderkey, filed, fp, ordinal FROM f WHERE fy = y AND fp = q QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY filed DESC, ended DESC, CAST(fp LIKE 'Q%' AS INT) DESC, ordinal DESC) = 1")
_add("period_of_facts", lambda s, d: packets.period_of_facts(_facts(s, d), ["l_orderkey"], "cutoff"), f"WITH {_FCT} SELECT l_orderkey, 'FY' || fy || CASE WHEN fp LIKE 'Q%' THEN ' ' || fp ELSE '' END AS fiscal_period FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY filed DESC, ended DESC, ordinal) = 1")


def _citations(s, d):
    n = F.col("event_id")
    say = F.concat(F.lit("a S"), (n % 7).cast("string"), F.lit(", b X"), F.lpad((n % 3).cast("string"), 3, "0"), F.lit(" c S"), (n % 5).cast("string"), F.lit(" d"))
    r = packets.repaired_citations(F.col("say"), F.array(*[F.lit(f"S00{i}") for i in range(1, 7)], F.lit("X000"), F.lit("X002")))
    return A.table(s, d, "events").select("event_id", say.alias("say")).select("event_id", r.alias("r")).select("event_id", F.col("r.text").alias("repaired"), F.size("r.repairs").alias("n_repairs"), F.array_join("r.unresolved", ",").alias("unresolved"), F.array_join("r.ignored", ",").alias("ignored"))


_add("citation_repair", _citations, """SELECT event_id, 'a ' || CASE WHEN event_id % 7 = 0 THEN 'S0' ELSE 'S00' || (event_id % 7) END || ', b ' || CASE event_id % 3 WHEN 1 THEN 'S001' ELSE 'X00' || (event_id % 3) END || ' c S' || (event_id % 5) || ' d' AS repaired,
CAST(event_id % 7 > 0 AS INT) + CAST(event_id % 3 = 1 AS INT) AS n_repairs, CASE WHEN event_id % 7 = 0 THEN 'S0' ELSE '' END AS unresolved, 'S' || (event_id % 5) AS ignored FROM events""")


def _company():
    return F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" Corp"))


def _packets(s, d):
    """A packet for each customer: its name, filing number and day in a sentence."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_custkey").cast("int"))
    say = F.concat(F.lit("For "), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit(" CORP (NYSE: CU9)  Jane Doe, CFO met on "), F.date_format(day, "MMMM d, yyyy"), F.lit(" about 0000-11-22; see 00001122."))
    return A.table(s, d, "customer").select("c_custkey", packets.masked_text(say, _company(), F.lit("CU9"), F.array(day), F.lit("0000-11-22"), F.lit("Company A")).alias("text"), F.col("c_mktsegment").alias("sector"))


_add("masked_packets", _packets, "SELECT c_custkey, c_mktsegment AS sector, 'For Company A (NYSE: Company A) CFO met on masked_timestamp about masked_accession; see masked_accession.' AS text FROM customer")


def _visible(s, d):
    m = A.table(s, d, "customer").where("c_custkey % 3 > 0").select("c_custkey", _company().alias("company"), F.lit("CU9").alias("ticker"), F.lit("Company A").alias("masked_company"), F.when(F.col("c_custkey") % 3 == 1, "noon").otherwise(" ").alias("accepted_at_et"), F.when(F.col("c_custkey") % 2 == 0, "CHANGED").alias("sector"))
    return packets.entity_visible(_packets(s, d), m, "c_custkey", ["sector"])


_add("entity_visible", _visible, """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS sector, CASE c_custkey % 3 WHEN 0 THEN 'For Company A (NYSE: Company A)' ELSE 'For ' || replace(c_name, '#', ' ') || ' Corp (NYSE:CU9)' END || ' CFO met on ' || CASE c_custkey % 3 WHEN 1 THEN 'noon' ELSE 'masked_timestamp' END || ' about masked_accession; see masked_accession.' AS text FROM customer""")
_add("leaf_blocks", lambda s, d: packets.leaf_blocks(A.table(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.count_distinct("heading").alias("n_headings"), F.sum(F.length("text")).alias("n_chars")))


def _edits(s, d):
    """Turns of conversations as evidence units, and a manifest of them; some lines do not fit."""
    n = F.col("conv_id") + F.col("turn")
    u = A.table(s, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("event_id"), F.col("turn").cast("string").alias("evidence_id"), F.col("role").alias("category"), F.lit("v").alias("value"), F.array(F.lit("S001")).alias("source_ids"), F.lit("direct").alias("support_label"), F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" of "), "role").alias("claim"), n.alias("n"))
    said = F.when(F.col("n") % 5 == 1, F.concat(F.lit("calm "), "claim")).when(F.col("n") % 5 == 2, F.concat("claim", F.lit(" 77"))).otherwise(F.col("claim"))
    m = u.where("n % 5 < 4").select("event_id", "evidence_id", F.when(F.col("n") % 10 == 3, "other").otherwise(F.col("category")).alias("category"), "value", "source_ids", "support_label", F.col("claim").alias("original_claim"), (F.col("n") % 5 > 0).alias("approved"), said.alias("proposed_t5_claim"))
    return u, m


_add("manifest_apply", lambda s, d: manifests.applied(*_edits(s, d)).select("event_id", "evidence_id", "claim", "changed", "error"), """WITH u AS (SELECT 'c' || conv_id AS event_id, CAST(turn AS VARCHAR) AS evidence_id, 'turn ' || turn || ' of ' || role AS c, conv_id + turn AS n FROM conversations)
SELECT event_id, evidence_id, CASE WHEN n % 5 = 1 THEN 'calm ' || c ELSE c END AS claim, n % 5 = 1 AS changed, CASE WHEN n % 5 = 4 THEN 'missing manifest key' WHEN n % 10 = 3 THEN 'category does not match' WHEN n % 5 = 2 THEN 'alters protected tokens' END AS error FROM u""")


def _adjudicated(s, d):
    m = _edits(s, d)[1]
    no = F.col("event_id").endswith("1")
    rulings = m.where("category = 'user'").select("event_id", "evidence_id", F.when(~no, F.lit("plain")).alias("claim"), F.array(F.struct(F.lit("of").alias("text"), F.array(F.lit("b"), F.lit("a")).alias("categories"))).alias("spans"), F.when(no, "kept").alias("reason"))
    return manifests.adjudicated(m, rulings).select("event_id", "evidence_id", "approved", "review_status", "proposed_t5_claim", F.col("candidate_frame_spans")[0]["start_char"].alias("span_start"), F.array_join("candidate_frame_categories", ",").alias("span_categories"), "adjudication_reason")


_add("manifest_adjudication", _adjudicated, f"""WITH u AS (SELECT 'c' || conv_id AS event_id, CAST(turn AS VARCHAR) AS evidence_id, 'turn ' || turn || ' of ' || role AS c, conv_id + turn AS n, role FROM conversations),
m AS (SELECT *, role = 'user' AND n % 10 <> 3 AS k, NOT ends_with(event_id, '1') AS y FROM u WHERE n % 5 < 4)
SELECT event_id, evidence_id, CASE WHEN k THEN y ELSE n % 5 > 0 END AS approved, CASE WHEN k AND y THEN 'approved' WHEN k THEN 'rejected' END AS review_status, CASE WHEN k AND y THEN 'plain' WHEN k THEN c WHEN n % 5 = 1 THEN 'calm ' || c WHEN n % 5 = 2 THEN c || ' 77' ELSE c END AS proposed_t5_claim,
CAST(CASE WHEN k AND y THEN strpos(c, 'of') - 1 END AS INT) AS span_start, CASE WHEN k AND y THEN 'a,b' END AS span_categories, CASE WHEN k AND y THEN '{manifests.APPROVAL}' WHEN k THEN 'kept' END AS adjudication_reason FROM m""")
_add("python_literal_repair", lambda s, d: A.table(s, d, "labels").select("doc_id", F.from_json(manifests.strict_json(F.concat(F.lit('{"toxic": '), F.when(F.col("toxic") == 1, "True").otherwise("False"), F.lit("}"))), "toxic boolean")["toxic"].alias("is_toxic")), "SELECT doc_id, toxic = 1 AS is_toxic FROM labels")
