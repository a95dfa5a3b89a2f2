"""Queries over decisions that the normaliser made from raw records, with the full key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import experiment as E
from tessella.plans.intake import BANKS, NORMAL, OUTCOMES, _BANK, _OUT, cte, decisions, records, view
from tessella.plans.registry import _add
from tessella.sources import intake as I

_KEY = "event_id, upstream_model_family, model_family, representation_seed, decision_seed, treatment, treatment_family"
_KEY6 = "event_id, upstream_model_family, model_family, representation_seed, decision_seed, investor_group"
_KEY4 = "event_id, model_family, investor_group, decision_seed"


def once(rows):
    """Rows that a query reads several times, kept so that they are parsed once."""
    return rows.persist()


def enriched(s, d, rows=None):
    """Usable decisions with outcome and categories."""
    rows = decisions(s, d) if rows is None else rows
    outcomes = I.hidden_outcomes(view(s, d, OUTCOMES))[0].select("event_id", F.col("CAR_1_5").alias("car"))
    return I.with_resolved_categories(rows.join(outcomes, "event_id", "left"), I.bank_index(view(s, d, BANKS))).drop("categories_from")


def full_cells(s, d, rows=None):
    return E.cells(enriched(s, d, rows))


#: Decisions with outcome (car) and categories on the SQL side.
RICH = f"""{NORMAL}, {_OUT.replace('raw', 'oraw').replace(' p AS', ' op AS').replace('FROM p)', 'FROM op)').replace('r AS (SELECT *, row_number', 'orr AS (SELECT *, row_number')}, {_BANK},
cx AS (SELECT row_number, event_id, unnest(list_distinct(evidence_used)) AS source_id FROM norm WHERE code IS NULL AND coalesce(len(own_categories), 0) = 0),
cg AS (SELECT row_number, list_sort(list_distinct(flatten(list(coalesce(x.categories, []))))) AS categories, count(x.categories) * 1.0 / count(*) AS coverage FROM cx LEFT JOIN bi x ON x.event_id = cx.event_id AND x.source_id = cx.source_id GROUP BY row_number),
rich AS (SELECT n.*, n.grp AS pg, o.car, coalesce(CASE WHEN len(n.own_categories) > 0 THEN list_sort(list_distinct(n.own_categories)) END, cg.categories) AS categories, CASE WHEN len(n.own_categories) > 0 THEN 1.0 ELSE cg.coverage END AS coverage
  FROM norm n LEFT JOIN (SELECT * FROM orr WHERE event_id IS NOT NULL AND rk = 1) o ON o.event_id = n.event_id LEFT JOIN cg ON cg.row_number = n.row_number WHERE n.code IS NULL)"""
_EXPECT = "CASE investor_group " + " ".join(f"WHEN '{g}' THEN [{', '.join(repr(p) for p in v)}]" for g, v in E.EXPECTED.items()) + " END"
_J = lambda c: f"CASE WHEN len(list_distinct(list_concat(x.{c}, y.{c}))) = 0 THEN 1.0 ELSE len(list_intersect(x.{c}, y.{c})) * 1.0 / len(list_distinct(list_concat(x.{c}, y.{c}))) END"
CELLS = f"""{RICH}, tw AS (SELECT *, count(*) OVER (PARTITION BY {_KEY}, profile_canonical) AS twice FROM rich), ws AS (SELECT *, max(twice) OVER (PARTITION BY {_KEY}) AS worst FROM tw),
rp AS (SELECT *, unnest(CASE WHEN pg = 'all_profiles' THEN ['all_profiles'] ELSE ['all_profiles', pg] END) AS investor_group FROM ws WHERE worst = 1),
prs AS (SELECT {', '.join('x.' + k.strip() for k in (_KEY + ', investor_group').split(','))}, avg(abs(x.er - y.er)) AS belief_mad, avg({_J('evidence_used')}) AS source_overlap, avg({_J('categories')}) AS cat_overlap
  FROM rp x JOIN rp y ON {' AND '.join(f'x.{k.strip()} = y.{k.strip()}' for k in (_KEY + ', investor_group').split(','))} AND x.row_number < y.row_number GROUP BY ALL),
ag AS (SELECT {_KEY}, investor_group, count(*) AS n, list_sort(list(DISTINCT profile_canonical)) AS profiles, stddev_pop(er) AS sd, quantile_cont(er, 0.75) - quantile_cont(er, 0.25) AS iqr, stddev_pop(confidence) AS cd,
  count(*) FILTER (act = 'buy') AS b, count(*) FILTER (act = 'hold') AS h, count(*) FILTER (act = 'sell') AS s, abs(avg(action_code)) AS net, bool_and(categories IS NOT NULL) AS all_have, avg(coverage) AS coverage, any_value(car) AS car,
  avg(CASE WHEN car IS NOT NULL THEN CASE WHEN (CASE WHEN er > 1e-12 THEN 1 WHEN er < -1e-12 THEN -1 ELSE 0 END) = (CASE WHEN car > 1e-12 THEN 1 WHEN car < -1e-12 THEN -1 ELSE 0 END) THEN 1.0 ELSE 0.0 END END) AS da,
  avg(CASE WHEN car IS NOT NULL THEN CASE WHEN action_code = (CASE WHEN car > 1e-12 THEN 1 WHEN car < -1e-12 THEN -1 ELSE 0 END) THEN 1.0 ELSE 0.0 END END) AS aa, avg(er - car) AS se, avg(abs(er - car)) AS ae FROM rp GROUP BY ALL),
cc AS (SELECT ag.*, prs.belief_mad, prs.source_overlap, CASE WHEN all_have AND coalesce(coverage, 0) > 0 THEN prs.cat_overlap END AS category_overlap, {_EXPECT} AS expect,
  -(CASE WHEN b > 0 THEN b * 1.0 / n * log2(b * 1.0 / n) ELSE 0 END + CASE WHEN h > 0 THEN h * 1.0 / n * log2(h * 1.0 / n) ELSE 0 END + CASE WHEN s > 0 THEN s * 1.0 / n * log2(s * 1.0 / n) ELSE 0 END) AS ent, (b * b + h * h + s * s) * 1.0 / (n * n) AS hhi
  FROM ag LEFT JOIN prs USING ({_KEY}, investor_group)),
fc AS (SELECT {_KEY}, investor_group, n AS profile_count, n = len(expect) AND len(list_filter(expect, lambda p: NOT list_contains(profiles, p))) = 0 AS is_complete_group,
  '[' || array_to_string(list_transform(list_sort(list_filter(expect, lambda p: NOT list_contains(profiles, p))), lambda p: '"' || p || '"'), ',') || ']' AS missing_profiles, n * (n - 1) // 2 AS pair_count,
  sd AS std_expected_return_5d, belief_mad, iqr AS iqr_expected_return_5d, cd AS confidence_dispersion, ent AS action_entropy, hhi AS action_hhi, 1 - hhi AS action_simpson, net AS net_direction, 1 - net AS direction_diversity, source_overlap, 1 - source_overlap AS source_diversity,
  category_overlap, 1 - category_overlap AS category_diversity, coverage::DOUBLE AS coverage, car, da AS directional_accuracy, aa AS action_accuracy, se AS signed_error, ae AS absolute_error FROM cc)"""
_DOUBLES = ["std_expected_return_5d", "belief_mad", "iqr_expected_return_5d", "confidence_dispersion", "action_entropy", "action_hhi", "action_simpson", "net_direction", "direction_diversity", "source_overlap", "source_diversity", "category_overlap", "category_diversity", "coverage", "car", "directional_accuracy", "action_accuracy", "signed_error", "absolute_error"]
_add("full_cells", lambda s, d: E.rounded(full_cells(s, d)[0], E.CELL), f"WITH {CELLS} SELECT {_KEY}, investor_group, profile_count, is_complete_group, missing_profiles, pair_count, {', '.join(f'round({m}, 6) AS {m}' for m in _DOUBLES)} FROM fc")
_add("full_cell_warnings", lambda s, d: full_cells(s, d)[1], f"WITH {CELLS} SELECT {_KEY}, string_agg(DISTINCT profile_canonical, ',' ORDER BY profile_canonical) AS profiles FROM ws WHERE twice > 1 GROUP BY ALL")
_STACK = "[" + ", ".join(f"struct_pack(metric := '{m}', v := {m})" for m in E.CONTRASTED) + "]"
LONG = f"""{CELLS}, u AS (SELECT {_KEY6}, treatment_family, unnest({_STACK}) AS q FROM fc), v AS (SELECT * EXCLUDE (q), q.metric AS metric, q.v AS v FROM u),
o6 AS (SELECT {_KEY6}, treatment_family, metric, any_value(v) AS v FROM v GROUP BY {_KEY6}, treatment_family, metric HAVING count(*) = 1), o4 AS (SELECT {_KEY4}, treatment_family, metric, any_value(v) AS v FROM v WHERE treatment_family IN ('T1', 'B0') GROUP BY {_KEY4}, treatment_family, metric HAVING count(*) = 1),
lg AS ({" UNION ALL ".join([f"SELECT {_KEY6}, '{n}' AS contrast, '{k}' AS index_type, metric, b.v AS baseline, c.v AS comparison, e.v AS denominator FROM (SELECT * FROM o6 WHERE treatment_family = '{b}') b JOIN (SELECT * FROM o6 WHERE treatment_family = '{c}') c USING ({_KEY6}, metric) LEFT JOIN (SELECT * FROM o6 WHERE treatment_family = '{e}') e USING ({_KEY6}, metric)" for n, b, c, e, k in E.PAIRED] + [f"SELECT {', '.join('c.' + k.strip() for k in _KEY6.split(','))}, '{n}', 'raw_delta', c.metric, b.v, c.v, NULL FROM (SELECT * FROM v WHERE treatment_family = '{c}') c JOIN (SELECT * FROM o4 WHERE treatment_family = '{b}') b USING ({_KEY4}, metric)" for n, b, c in E.REPEATED])}),
lo AS (SELECT *, comparison - baseline AS delta, CASE WHEN comparison - baseline IS NULL THEN false WHEN index_type = 'raw_delta' THEN true ELSE coalesce(abs(denominator) >= 1e-6, false) END AS is_stable FROM lg),
ll AS (SELECT *, CASE WHEN index_type <> 'raw_delta' AND is_stable THEN delta / denominator END AS normalized_index FROM lo)"""


def long_contrasts(s, d):
    return E.contrasts(full_cells(s, d)[0])


_add("full_contrasts", lambda s, d: E.rounded(long_contrasts(s, d)[0], E.PAIR), f"WITH {LONG} SELECT {_KEY6}, contrast, index_type, metric, {', '.join(f'round({m}, 6) AS {m}' for m in ('baseline', 'comparison', 'denominator', 'delta', 'normalized_index'))}, is_stable FROM ll")
_add("full_contrast_warnings", lambda s, d: long_contrasts(s, d)[1], f"""WITH {CELLS} SELECT concat_ws('|', {_KEY6}) AS key, treatment_family AS family FROM fc WHERE treatment_family IN ('T2', 'T3', 'T4') GROUP BY {_KEY6}, treatment_family HAVING count(*) > 1
UNION ALL SELECT concat_ws('|', {_KEY4}), treatment_family FROM fc WHERE treatment_family IN ('T1', 'B0') GROUP BY {_KEY4}, treatment_family HAVING count(*) > 1""")
_add("full_contrasts_wide", lambda s, d: E.rounded(E.wide_contrasts(full_cells(s, d)[0]), E.PAIR), f"""WITH {CELLS}, t2 AS (SELECT * FROM fc WHERE treatment_family = 'T2' QUALIFY count(*) OVER (PARTITION BY {_KEY6}) = 1), t3 AS (SELECT * FROM fc WHERE treatment_family = 'T3' QUALIFY count(*) OVER (PARTITION BY {_KEY6}) = 1)
SELECT {_KEY6}, {', '.join(f'round(t3.{m} - t2.{m}, 6) AS {m}_delta, round(CASE WHEN t3.{m} >= 1e-6 THEN (t3.{m} - t2.{m}) / t3.{m} END, 6) AS {m}_sci' for m in E.CONTRASTED)} FROM t2 JOIN t3 USING ({_KEY6})""")


def _high_risk(s, d):
    return view(s, d, "SELECT DISTINCT 'evt_' || o_orderkey AS event_id FROM {orders} WHERE o_orderkey % 3 = 0")


def acts(s, d, rows=None):
    return E.action_cells(E.sample_of(F.col("event_id"), _high_risk(s, d), decisions(s, d) if rows is None else rows))


_SAMPLE = "CASE WHEN event_id IN (SELECT 'evt_' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0) THEN 'high_risk16' ELSE 'non_high_risk' END"
ACTS = f"""{NORMAL}, rq AS (SELECT *, {_SAMPLE} AS sample, unnest(['all_profiles', grp]) AS investor_group FROM norm WHERE code IS NULL AND grp IN ('retail', 'institutional')),
ra AS (SELECT {_KEY}, sample, investor_group, count(*) AS n, count(*) FILTER (act = 'buy') AS b, count(*) FILTER (act = 'hold') AS h, count(*) FILTER (act = 'sell') AS s, abs(avg(action_code)) AS net, avg(action_strength) AS mean_strength, avg(confidence) AS mean_confidence FROM rq GROUP BY ALL),
ac AS (SELECT *, -(CASE WHEN b > 0 THEN b * 1.0 / n * log2(b * 1.0 / n) ELSE 0 END + CASE WHEN h > 0 THEN h * 1.0 / n * log2(h * 1.0 / n) ELSE 0 END + CASE WHEN s > 0 THEN s * 1.0 / n * log2(s * 1.0 / n) ELSE 0 END) AS action_entropy, (b * b + h * h + s * s) * 1.0 / (n * n) AS action_hhi,
  CASE WHEN n > 1 THEN (b * (b - 1) + h * (h - 1) + s * (s - 1)) * 1.0 / (n * (n - 1)) END AS same_share, net AS net_direction, (b + s) * 1.0 / n AS trade_rate, h * 1.0 / n AS hold_share FROM ra)"""
_add("full_action_cells", lambda s, d: E.rounded(acts(s, d), E.CELL), f"""WITH {ACTS} SELECT {_KEY}, sample, investor_group, n AS profile_count, b AS buy_count, h AS hold_count, s AS sell_count, round(b * 1.0 / n, 6) AS buy_share, round(hold_share, 6) AS hold_share, round(s * 1.0 / n, 6) AS sell_share, round(trade_rate, 6) AS trade_rate,
  round(action_entropy, 6) AS action_entropy, round(action_entropy / log2(3), 6) AS entropy_normalized, round(action_hhi, 6) AS action_hhi, round(1 - action_hhi, 6) AS action_simpson, round(same_share, 6) AS same_share, round(1 - same_share, 6) AS action_diversity, round(net, 6) AS net_direction, round(1 - net, 6) AS direction_diversity, round(mean_strength, 6) AS mean_strength, round(mean_confidence, 6) AS mean_confidence FROM ac""")
_AM = [*E.ACTION_METRICS, "mean_strength", "mean_confidence"]
_add("action_means", lambda s, d: E.action_means(acts(s, d)), f"WITH {ACTS}, f AS (SELECT * REPLACE (unnest(['full', sample]) AS sample) FROM ac) SELECT sample, treatment_family, investor_group, count(*) AS n_cells, count(DISTINCT event_id) AS n_events, {', '.join(f'round(avg({m}), 7) AS {m}' for m in _AM)} FROM f GROUP BY sample, treatment_family, investor_group")
REPS = 500


def _boot(values: str, by: str, reps: int = REPS) -> str:
    return f"""nb AS (SELECT * REPLACE (round(delta, 12) AS delta), row_number() OVER (PARTITION BY {by} ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {values} WHERE delta IS NOT NULL),
sb AS (SELECT {by}, any_value(n) AS n, avg(delta) AS mean_delta, median(delta) AS median_delta, avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END) AS positive_share FROM nb GROUP BY {by}),
db AS (SELECT n, rep, slot, CAST(('0x' || substr(md5(rep || ':' || slot), 1, 12)) AS BIGINT) % n AS i FROM (SELECT DISTINCT n FROM sb), range({reps}) t(rep), LATERAL (SELECT unnest(range(n)) AS slot)),
mb AS (SELECT {', '.join('nb.' + c.strip() for c in by.split(','))}, rep, round(avg(delta), 12) AS mu FROM db JOIN nb ON nb.n = db.n AND nb.i = db.i GROUP BY ALL),
cb AS (SELECT {by}, quantile_cont(mu, 0.025) AS ci_low, quantile_cont(mu, 0.975) AS ci_high, least(1.0, 2 * least(avg(CASE WHEN mu <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN mu >= 0 THEN 1.0 ELSE 0.0 END))) AS p_value FROM mb GROUP BY {by}),
bt AS (SELECT {by}, sb.n AS n_events, mean_delta, median_delta, positive_share, ci_low, ci_high, p_value FROM sb JOIN cb USING ({by}))"""


_BM = {m: m for m in E.TESTED_METRICS} | {"entropy_normalized": "action_entropy / log2(3)", "action_simpson": "1 - action_hhi", "action_diversity": "1 - same_share"}
_add(
    "action_contrasts", lambda s, d: E.rounded(E.action_contrasts(once(acts(s, d))), []),
    f"""WITH {ACTS}, f AS (SELECT * REPLACE (unnest(['full', sample]) AS sample) FROM ac), em AS (SELECT sample, investor_group, event_id, treatment_family, {', '.join(f'avg({x}) AS {m}' for m, x in _BM.items())} FROM f GROUP BY 1, 2, 3, 4), lm AS (UNPIVOT em ON {', '.join(_BM)} INTO NAME metric VALUE v),
wm AS (SELECT sample, investor_group, event_id, metric, {', '.join(f"max(v) FILTER (treatment_family = '{t}') AS {t}" for t in ('T1', 'B0', 'T2', 'T3', 'T4'))} FROM lm GROUP BY 1, 2, 3, 4),
dm AS ({" UNION ALL ".join(f"SELECT sample, investor_group, event_id, metric, '{n}' AS contrast, {c} - {b} AS delta FROM wm" for n, c, b in E.ACTION_CONTRASTS)}), {_boot('dm', 'sample, investor_group, contrast, metric', 5000)},
rk AS (SELECT *, row_number() OVER (PARTITION BY sample, investor_group ORDER BY round(p_value, 9), contrast || '|' || metric) AS r, count(*) OVER (PARTITION BY sample, investor_group) AS m FROM bt)
SELECT sample, investor_group, contrast, metric, n_events, {', '.join(f'round({m}, 6) AS {m}' for m in ('mean_delta', 'median_delta', 'positive_share', 'ci_low', 'ci_high', 'p_value'))}, round(least(1.0, min(p_value * m / r) OVER (PARTITION BY sample, investor_group ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q_value FROM rk""",
)
_add("contrast_bootstrap", lambda s, d: E.rounded(E.contrast_bootstrap(once(long_contrasts(s, d)[0].where("metric = 'belief_mad'")), "belief_mad", REPS), []), f"""WITH {LONG}, rw AS (SELECT contrast, unnest(['all_models', model_family]) AS model, event_id, delta FROM ll WHERE metric = 'belief_mad' AND investor_group = 'all_profiles' AND delta IS NOT NULL), zz AS (SELECT contrast, model, count(*) AS n_rows, avg(delta) AS row_mean_delta FROM rw GROUP BY 1, 2),
ev AS (SELECT contrast, model, event_id, avg(delta) AS delta FROM rw GROUP BY 1, 2, 3), {_boot('ev', 'contrast, model')} SELECT contrast, model, n_rows, round(row_mean_delta, 6) AS row_mean_delta, n_events, {', '.join(f'round({m}, 6) AS {m}' for m in ('mean_delta', 'median_delta', 'positive_share', 'ci_low', 'ci_high', 'p_value'))}, ci_low > 0 OR ci_high < 0 AS ci_excludes_zero FROM bt JOIN zz USING (contrast, model)""")
_plus = lambda: F.coalesce((F.col("expected_return_5d") > 0).cast("double"), F.lit(0.0))


def _frozen(s, d):
    rows = once(decisions(s, d).select("event_id", "treatment_family", "expected_return_5d"))
    both = rows.where("treatment_family in ('T1', 'T2')").groupBy("event_id").agg(F.count_distinct("treatment_family").alias("n")).where("n = 2")
    return E.frozen_deltas(rows, both, "T1", "T2", _plus())


_FROZEN = f"{NORMAL}, fz AS (SELECT event_id, avg(CASE WHEN er > 0 THEN 1.0 ELSE 0.0 END) FILTER (treatment_family = 'T2') - avg(CASE WHEN er > 0 THEN 1.0 ELSE 0.0 END) FILTER (treatment_family = 'T1') AS delta FROM norm WHERE code IS NULL GROUP BY event_id)"
_add("frozen_deltas", lambda s, d: E.rounded(_frozen(s, d), []), f"WITH {_FROZEN} SELECT event_id, round(delta, 6) AS delta FROM fz WHERE delta IS NOT NULL")


def _layers(s, d):
    rows = once(decisions(s, d).drop("rationale_text", "key_reasons", "uncertainty_notes"))
    return E.layer_correlations(acts(s, d, rows), full_cells(s, d, rows)[0])


_add("layer_correlations", _layers, f"""WITH {CELLS}, {ACTS.split(NORMAL + ', ')[1]}, jm AS (SELECT ac.treatment_family, ac.action_hhi, 1 - ac.action_hhi AS action_simpson, ac.same_share, ac.hold_share, fc.source_diversity, fc.category_diversity, fc.belief_mad FROM ac LEFT JOIN fc ON {' AND '.join(f'ac.{k.strip()} = fc.{k.strip()}' for k in (_KEY + ', investor_group').split(','))} WHERE ac.investor_group = 'all_profiles'),
js AS (SELECT *, unnest(['all', treatment_family]) AS treatment_set FROM jm), jp AS ({" UNION ALL ".join(f"SELECT treatment_set, '{a}' AS action_metric, '{b}' AS paired_metric, round({a}, 9) AS x, round({b}, 9) AS y FROM js" for a in ("action_hhi", "action_simpson", "same_share", "hold_share") for b in ("source_diversity", "category_diversity", "belief_mad"))}),
jr AS (SELECT treatment_set, action_metric, paired_metric, rank() OVER (PARTITION BY treatment_set, action_metric, paired_metric ORDER BY x) + (count(*) OVER (PARTITION BY treatment_set, action_metric, paired_metric, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY treatment_set, action_metric, paired_metric ORDER BY y) + (count(*) OVER (PARTITION BY treatment_set, action_metric, paired_metric, y) - 1) / 2.0 AS ry FROM jp WHERE x IS NOT NULL AND y IS NOT NULL),
jc AS (SELECT treatment_set, action_metric, paired_metric, count(*) AS n_cells, corr(rx, ry) AS rho FROM jr GROUP BY 1, 2, 3), je AS (SELECT DISTINCT treatment_set, action_metric, paired_metric FROM jp)
SELECT treatment_set, action_metric, paired_metric, coalesce(n_cells, 0) AS n_cells, round(CASE WHEN n_cells >= 3 AND NOT isnan(rho) THEN rho END, 6) AS rho FROM je LEFT JOIN jc USING (treatment_set, action_metric, paired_metric)""")
_UM = ["belief_mad", "action_entropy"]
_tm = lambda s, d: full_cells(s, d)[0].where("investor_group = 'all_profiles'").groupBy("treatment_family").agg(*[F.avg(m).alias(m) for m in _UM])
_add("unpaired_delta", lambda s, d: E.unpaired_delta(_tm(s, d), "T3", "B0", _UM), f"WITH {CELLS}, t AS (SELECT treatment_family, {', '.join(f'avg({m}) AS {m}' for m in _UM)} FROM fc WHERE investor_group = 'all_profiles' GROUP BY 1) SELECT 'T3_minus_B0' AS contrast, {', '.join(f'round((SELECT {m} FROM t WHERE treatment_family = ' + chr(39) + 'T3' + chr(39) + f') - (SELECT {m} FROM t WHERE treatment_family = ' + chr(39) + 'B0' + chr(39) + f'), 6) AS {m}' for m in _UM)}")
_add("bundle_means", lambda s, d: E.means_of_present(E.rounded(full_cells(s, d)[0], E.CELL), ["treatment_family", "run_label", "model_family"], ["belief_mad", "absent_metric", "car"]), f"WITH {CELLS} SELECT treatment_family, model_family, count(*) AS row_count, round(avg(round(belief_mad, 6)), 6) AS belief_mad, round(avg(round(car, 6)), 6) AS car FROM fc GROUP BY 1, 2")
_add("overall_summary", lambda s, d: E.overall(full_cells(s, d)[0], ["belief_mad", "source_diversity"]), f"WITH {CELLS} SELECT count(*) AS n_cells, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(median({m}), 6) AS {m}_median, round(avg(CASE WHEN {m} > 0 THEN 1.0 WHEN {m} IS NOT NULL THEN 0.0 END), 6) AS {m}_positive_share' for m in ('belief_mad', 'source_diversity'))} FROM fc")
_ES, _CS = (f"CASE WHEN {c} > 1e-12 THEN 1 WHEN {c} < -1e-12 THEN -1 ELSE 0 END" for c in ("er", "car"))
_add("quality_readout", lambda s, d: E.quality_readout(enriched(s, d)), f"""WITH {RICH}, q AS (SELECT *, CASE WHEN ({_ES}) = ({_CS}) THEN 1.0 ELSE 0.0 END AS ok, CASE WHEN action_code = ({_CS}) THEN 1.0 ELSE 0.0 END AS okc, action_code <> 0 AS trade FROM rich WHERE car IS NOT NULL)
SELECT treatment_family, count(*) AS n_decisions, count(DISTINCT event_id) AS n_events, round(avg(ok), 6) AS directional_accuracy, round(avg(okc), 6) AS strict_action_accuracy, round(avg(okc) FILTER (trade), 6) AS trade_only_accuracy, round(avg(CASE WHEN trade THEN 0.0 ELSE 1.0 END) FILTER (abs(car) <= 0.01), 6) AS hold_neutral_accuracy,
round(avg((confidence - ok) * (confidence - ok)), 6) AS confidence_brier, round(sum(confidence * ok) / sum(confidence), 6) AS confidence_weighted_accuracy, round(avg(CASE WHEN trade THEN 1.0 ELSE 0.0 END), 6) AS trade_rate, round(avg(CASE WHEN trade THEN 0.0 ELSE 1.0 END), 6) AS hold_rate FROM q GROUP BY 1""")
_add("variance_parts", lambda s, d: E.variance_parts(decisions(s, d)), f"""WITH {NORMAL}, p AS (SELECT event_id, treatment_family, profile_canonical, avg(er) AS m, var_pop(er) AS w FROM norm WHERE code IS NULL GROUP BY 1, 2, 3), c AS (SELECT event_id, treatment_family, var_pop(m) AS b, avg(w) AS w FROM p GROUP BY 1, 2)
SELECT treatment_family, count(*) AS n, round(avg(b), 6) AS between_variance, round(avg(w), 6) AS within_variance, round(avg(CASE WHEN w > 1e-12 THEN b / w END), 6) AS signal_to_noise, round(avg(CASE WHEN b + w > 1e-12 THEN b / (b + w) END), 6) AS icc_like FROM c GROUP BY 1""")
_add("expected_counts", lambda s, d: E.expected_counts(s, 94, 4, 4, 6, 3, 2, ["T1_raw", "B0_canonical", "T2_shared", "T3_profile", "T4_ledger"]), "SELECT * FROM (VALUES ('T1_raw', 94, 4512), ('B0_canonical', 94, 4512), ('T2_shared', 1128, 54144), ('T3_profile', 6768, 54144), ('T4_ledger', 94, 4512)) v(treatment, representations, decisions)".replace("94,", "CAST(94 AS BIGINT),"))


def _summary(s, d):
    rows = once(I.normalised(records(s, d)).drop("rationale_text", "key_reasons", "uncertainty_notes"))
    cells = once(full_cells(s, d, I.usable(rows))[0])
    return E.run_summary(rows, cells, E.contrasts(cells)[0])


_add("run_summary", _summary, f"WITH {LONG} SELECT count(*) AS records, count(*) FILTER (code IS NULL) AS usable, count(*) FILTER (code = 'missing_or_unparseable_fields') AS unparseable, count(*) FILTER (code = 'invalid_action') AS invalid_actions, (SELECT count(*) FROM fc) AS cells, (SELECT count(*) FROM fc WHERE is_complete_group) AS complete_cells, (SELECT count(*) FROM ll) AS contrast_rows, (SELECT count(*) FROM ll WHERE NOT is_stable) AS unstable_rows FROM norm")
