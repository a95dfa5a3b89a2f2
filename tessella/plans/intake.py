"""Queries of the intake operators over raw JSON and CSV text, which one SQL text makes from the star-schema tables for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.registry import _add
from tessella.sources import adapters as A
from tessella.sources import intake as I

#: Decision records as JSON text, about one in eight of them odd: other types, aliases, repeats, broken text.
RAW = """
SELECT event_id AS ordinal,
  CASE WHEN event_id % 173 = 5 THEN 'oops' || chr(123) WHEN event_id % 179 = 5 THEN '[1, 2]' ELSE
  chr(123) || '"event_id": ' || CASE WHEN event_id % 181 = 5 THEN '17' WHEN event_id % 191 = 5 THEN '"  "' ELSE '" evt_' || CAST(floor(event_id / 240.0) AS BIGINT) || '"' END
  || ', "treatment": "' || CASE CAST(floor(event_id / 6.0) AS BIGINT) % 5 WHEN 0 THEN 'T1_raw' WHEN 1 THEN 'B0' WHEN 2 THEN 'T2_shared' WHEN 3 THEN 'T3_profile' ELSE 'T4_ledger' END || '"'
  || ', "profile": "' || CASE WHEN event_id % 197 = 5 THEN 'mystery' ELSE CASE event_id % 6 WHEN 0 THEN 'day_trader' WHEN 1 THEN 'retail_swing_trader' WHEN 2 THEN 'long_term_retail' WHEN 3 THEN 'event_driven_hedge_fund'
       WHEN 4 THEN 'institutional_prop_trader' ELSE CASE WHEN event_id % 199 = 5 THEN 'prop_trading' WHEN event_id % 211 = 5 THEN 'unprofiled_baseline' ELSE 'investment_advisor' END END END || '"'
  || CASE WHEN event_id % 6 = 0 THEN ', "profile_group": "retail"' ELSE '' END
  || ', "model_family": "m' || CAST(floor(event_id / 30.0) AS BIGINT) % 2 || '"'
  || CASE WHEN event_id % 3 = 0 THEN '' WHEN CAST(floor(event_id / 6.0) AS BIGINT) % 5 < 2 THEN '' ELSE CASE WHEN event_id % 2 = 0 THEN ', "upstream_model_family": "u0"' ELSE ', "request_metadata": ' || chr(123) || '"passthrough_fields": ' || chr(123) || '"upstream_model_family": "u0"' || chr(125) || chr(125) END END
  || ', "representation_seed": ' || CASE WHEN event_id % 223 = 5 THEN '"x1"' WHEN event_id % 227 = 5 THEN '1.5' WHEN CAST(floor(event_id / 6.0) AS BIGINT) % 5 < 2 THEN '0' ELSE CASE WHEN event_id % 6 = 1 THEN '"' || CAST(floor(event_id / 120.0) AS BIGINT) % 2 || '"' ELSE CAST(floor(event_id / 120.0) AS BIGINT) % 2 || '.0' END END
  || ', "decision_seed": ' || CASE WHEN event_id % 229 = 5 THEN 'true' ELSE '' || (1 + CAST(floor(event_id / 60.0) AS BIGINT) % 2) END
  || ', "expected_return_5d": ' || CASE WHEN event_id % 233 = 5 THEN 'null' WHEN event_id % 239 = 5 THEN '"n/a"' ELSE CASE WHEN event_id % 4 = 0 THEN '"' ELSE '' END || CASE WHEN event_id % 7 < 3 THEN '-' ELSE '' END || '0.' || lpad('' || (event_id * 7919 % 2000), 4, '0') || CASE WHEN event_id % 4 = 0 THEN '"' ELSE '' END END
  || ', "confidence": 0.' || lpad('' || (event_id * 31 % 100), 2, '0')
  || ', "action": "' || CASE WHEN event_id % 241 = 5 THEN 'short' ELSE CASE event_type WHEN 'purchase' THEN ' BUY ' WHEN 'signup' THEN 'buy' WHEN 'error' THEN 'Sell' ELSE 'hold' END END || '"'
  || ', "action_strength": ' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END || '0.' || (event_id % 10)
  || ', "key_reasons": ' || CASE WHEN event_id % 251 = 5 THEN '"none"' ELSE '["Reason ' || (event_id % 5) || '", 7, " and ' || event_type || ' "]' END
  || ', "evidence_used": ["S00' || (event_id % 7) || '", "S00' || (event_id * 3 % 7) || '", "X00' || (event_id % 3) || '", "S00' || (event_id % 7) || '"]'
  || CASE WHEN event_id % 11 = 0 THEN ', "evidence_categories": ["own", "cash", "own"]' ELSE '' END
  || chr(125) END AS value
FROM {events}"""

#: Evidence banks and source packets of events as JSON text.
BANKS = """
SELECT c_custkey AS ordinal, chr(123) || '"event_id": "evt_' || c_custkey || '", "evidence_units": [' ||
  chr(123) || '"evidence_id": "E_SRC_001", "category": "revenue", "claim": "Sales of ' || c_name || ' rose.", "source_ids": ["S000", "X001"]' || chr(125) || ', ' ||
  chr(123) || '"evidence_id": "E_SRC_002", "evidence_category": "' || lower(c_mktsegment) || '", "claim": "b-c d", "source_ids": ["S00' || (c_custkey % 7) || '", "S000", "CTX1", " "]' || chr(125) || ', ' ||
  chr(123) || '"evidence_id": "E_SRC_003", "category": " ", "claim": "none", "source_ids": ["S006"]' || chr(125) || ', 5]' || chr(125) AS value FROM {customer}"""
PACKETS = """
SELECT c_custkey AS ordinal, chr(123) || '"event_id": "evt_' || c_custkey || '", "source_units": [' ||
  chr(123) || '"source_id": "S00' || (c_custkey % 7) || '", "section": "revenue"' || chr(125) || ', ' || chr(123) || '"source_id": "S002", "section": ""' || chr(125) || ', ' || chr(123) || '"source_id": "S00' || (c_custkey % 7) || '", "section": "general"' || chr(125) ||
  '], "xbrl_facts": [' || chr(123) || '"source_id": "X00' || (c_custkey % 3) || '", "tag": "NetIncomeLoss"' || chr(125) || ']' || chr(125) AS value FROM {customer}"""
#: Outcome rows as text, with blank and repeated ids and odd numbers.
OUTCOMES = """
SELECT o_orderkey AS row_number, CASE WHEN o_orderkey % 89 = 0 THEN '  ' WHEN o_orderkey % 97 = 0 THEN 'evt_1' ELSE ' evt_' || o_orderkey END AS event_id,
  CASE WHEN o_orderkey % 83 = 0 THEN 'nan' WHEN o_orderkey % 79 = 0 THEN '' ELSE CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END || '0.' || lpad('' || (o_orderkey * 37 % 1000), 3, '0') END AS hidden_CAR_1_5,
  CASE o_orderkey % 4 WHEN 0 THEN ' positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' ELSE '' END AS hidden_valence FROM {orders}"""
#: Model answers as text, most with something around the object.
ANSWERS = """
SELECT conv_id * 100 + turn AS ordinal, CASE (conv_id + turn) % 6
  WHEN 0 THEN '  ' || body || ' ' WHEN 1 THEN 'Here it is: ```json' || chr(10) || body || chr(10) || '``` done' WHEN 2 THEN 'I think ' || body || ' is right' WHEN 3 THEN text WHEN 4 THEN '[' || body || ']' ELSE '``` ' || body || '```' END AS value
FROM (SELECT conv_id, turn, text, chr(123) || '"expected_return_5d": ' || CASE WHEN conv_id % 3 = 0 THEN '0.9' WHEN conv_id % 3 = 1 THEN '"-0.5"' ELSE '0.0' || (conv_id % 90 + 10) END || ', "confidence": ' || (turn % 3) || '.5, "action": " ' ||
  CASE WHEN turn % 2 = 0 THEN 'BUY' ELSE 'Hold' END || '", "action_strength": -0.25, "key_reasons": ' || CASE conv_id % 4 WHEN 0 THEN '["a", " b ", ""]' WHEN 1 THEN '"- one' || chr(92) || 'n* two' || chr(92) || 'n- three"' WHEN 2 THEN '"single"' ELSE '"[' || chr(92) || '"x' || chr(92) || '"]"' END ||
  ', "evidence_used": ' || CASE conv_id % 3 WHEN 0 THEN '["S001", "bad", "X002", "S001"]' WHEN 1 THEN '"see S003, X004 and S003"' ELSE 'null' END || chr(125) AS body FROM {conversations}) x"""


def view(s, d, sql: str):
    names = [n for n in ("events", "customer", "orders", "conversations", "documents", "benchmark", "pages") if "{" + n + "}" in sql]
    return s.sql(sql, **{n: A.table(s, d, n) for n in names})


def cte(name: str, sql: str) -> str:
    for n in ("events", "customer", "orders", "conversations", "documents", "benchmark", "pages"):
        sql = sql.replace("{" + n + "}", n)
    return f"{name} AS MATERIALIZED ({sql})"


def _text(field: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '$.{field}') = 'VARCHAR' THEN nullif(trim(json_extract_string({j}, '$.{field}'), ' \t\n'), '') END"


def _number(field: str) -> str:
    t = f"trim(json_extract_string(j, '$.{field}'))"
    return f"CASE WHEN json_type(j, '$.{field}') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') AND regexp_full_match({t}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({t} AS DOUBLE) END"


def _whole(field: str) -> str:
    t = f"trim(json_extract_string(j, '$.{field}'))"
    return f"CASE WHEN json_type(j, '$.{field}') = 'VARCHAR' AND regexp_full_match({t}, '[+-]?\\d+') THEN TRY_CAST({t} AS BIGINT) WHEN json_type(j, '$.{field}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND regexp_full_match({t}, '[+-]?\\d+(\\.0+)?') THEN CAST(TRY_CAST({t} AS DOUBLE) AS BIGINT) END"


def _list(field: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '$.{field}') = 'ARRAY' THEN list_filter(list_transform(json_extract({j}, '$.{field}[*]'), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN nullif(trim(x ->> '$'), '') END), lambda y: y IS NOT NULL) END"


_NEED = ("event_id", "treatment", "profile", "model_family", "representation_seed", "decision_seed", "er", "confidence", "action", "action_strength", "key_reasons", "evidence_used")
_SHOWN = {"er": "expected_return_5d"}
_PROFILE = " ".join(f"WHEN '{p}' THEN '{c}'" for p, (c, _) in I.PROFILES.items())
_GROUP = " ".join(f"WHEN '{p}' THEN '{g}'" for p, (_, g) in I.PROFILES.items())
_UP = " ".join(f"WHEN '{t}' THEN '{u}'" for t, u in I.UPSTREAM.items())
NORMAL = f"""{cte('raw', RAW)},
pj AS (SELECT ordinal, value, json_valid(value) AS good, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM raw),
pf AS (SELECT ordinal AS row_number, coalesce(json_type(j) = 'OBJECT', false) AS is_object, {", ".join(f"{_text(f)} AS {f}" for f in ("event_id", "treatment", "profile", "profile_group", "model_family", "action"))},
  {_whole('representation_seed')} AS representation_seed, {_whole('decision_seed')} AS decision_seed, {_number('expected_return_5d')} AS er, {_number('confidence')} AS confidence, {_number('action_strength')} AS action_strength,
  {_list('key_reasons')} AS key_reasons, {_list('evidence_used')} AS evidence_used, {_list('evidence_categories')} AS own_categories,
  coalesce({_text('upstream_model_family')}, {_text('request_metadata.passthrough_fields.upstream_model_family')}) AS up FROM pj),
pn AS (SELECT *, split_part(treatment, '_', 1) AS treatment_family, coalesce(profile_group, CASE profile {_GROUP} END) AS grp, CASE profile {_PROFILE} ELSE profile END AS profile_canonical, lower(action) AS act,
  array_to_string(list_filter([{", ".join(f"CASE WHEN {n} IS NULL THEN '{_SHOWN.get(n, n)}' END" for n in _NEED)}], lambda x: x IS NOT NULL), ',') AS missing FROM pf),
norm AS (SELECT *, coalesce(up, CASE treatment_family {_UP} ELSE '{I.LEGACY_UPSTREAM}' END) AS upstream_model_family, CASE act WHEN 'buy' THEN 1 WHEN 'hold' THEN 0 WHEN 'sell' THEN -1 END AS action_code,
  CASE WHEN NOT is_object THEN 'invalid_row_type' WHEN missing <> '' THEN 'missing_or_unparseable_fields' WHEN act NOT IN ('buy', 'hold', 'sell') THEN 'invalid_action' WHEN grp IS NULL THEN 'unknown_profile_group' END AS code FROM pn)"""


def records(s, d):
    """Raw records, dealt out first: the table may be a single row group, and parsing it is the work."""
    n = max(s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    return s.sql(RAW, events=A.table(s, d, "events").repartition(n, "event_id"))


def decisions(s, d):
    """Usable decisions of the raw records."""
    return I.usable(I.normalised(records(s, d)))


_add(
    "normalised_decisions",
    lambda s, d: decisions(s, d).select("row_number", "event_id", "treatment", "treatment_family", "profile_canonical", "profile_group", "model_family", "upstream_model_family", "representation_seed", "decision_seed", F.round("expected_return_5d", 6).alias("expected_return_5d"), "confidence", "action", "action_code", "action_strength", "rationale_text", F.array_join("evidence_used", ",").alias("evidence_used")),
    f"""WITH {NORMAL} SELECT row_number, event_id, treatment, treatment_family, profile_canonical, grp AS profile_group, model_family, upstream_model_family, representation_seed, decision_seed, round(er, 6) AS expected_return_5d, confidence, act AS action, action_code,
  action_strength, array_to_string(key_reasons, ' ') AS rationale_text, array_to_string(evidence_used, ',') AS evidence_used FROM norm WHERE code IS NULL""",
)
_add("quarantined_decisions", lambda s, d: I.normalised(records(s, d)).where("code is not null").select("row_number", "code", "fields"), f"WITH {NORMAL} SELECT row_number, code, CASE WHEN code = 'missing_or_unparseable_fields' THEN missing ELSE '' END AS fields FROM norm WHERE code IS NOT NULL")
_add("upstream_families", lambda s, d: decisions(s, d).groupBy("treatment_family", "upstream_model_family").agg(F.count("*").alias("n")), f"WITH {NORMAL} SELECT treatment_family, upstream_model_family, count(*) AS n FROM norm WHERE code IS NULL GROUP BY ALL")

_SNIFF = """SELECT 'f' || conv_id || '-' || turn || CASE WHEN turn % 5 = 1 THEN '.jsonl' ELSE '.json' END AS path,
  CASE turn % 7 WHEN 0 THEN '  ' WHEN 1 THEN chr(123) || '"a": 1' || chr(125) || chr(10) || chr(10) || 'broken' || chr(10) || ' ' || chr(123) || '"a": 2' || chr(125) WHEN 2 THEN ' [1, "b", ' || chr(123) || '"c": null' || chr(125) || ']' WHEN 3 THEN chr(123) || '"d": ' || conv_id || chr(125)
  WHEN 4 THEN '7' WHEN 5 THEN 'x' || chr(10) || chr(123) || '"e": 5' || chr(125) ELSE chr(123) || '"f": 1' || chr(125) END AS content FROM {conversations}"""
_add(
    "sniffed_records",
    lambda s, d: I.sniffed(view(s, d, _SNIFF)).select("path", "ordinal", "format", F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), F.regexp_replace("value", r"\s+", "")).otherwise("").alias("value")),
    f"""WITH {cte('f', _SNIFF)}, g AS (SELECT *, trim(content, ' ' || chr(10)) AS t, json_valid(content) AS ok, CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM f),
k AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN t[1] = '[' THEN 'json_array' WHEN path LIKE '%.jsonl' OR NOT ok THEN 'jsonl' WHEN json_type(j) = 'OBJECT' THEN 'json_object' ELSE 'scalar' END AS format FROM g),
a AS (SELECT path, format, unnest(json_extract(j, '$[*]')) AS item, generate_subscripts(json_extract(j, '$[*]'), 1) AS ordinal FROM k WHERE format = 'json_array'),
l AS (SELECT path, format, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ordinal FROM k WHERE format = 'jsonl')
SELECT path, CAST(ordinal AS BIGINT) AS ordinal, format, '' AS error, regexp_replace(CAST(item AS VARCHAR), '\\s+', '', 'g') AS value FROM a
UNION ALL SELECT path, CAST(ordinal AS BIGINT), format, CASE WHEN json_valid(line) THEN '' ELSE 'invalid_jsonl_line' END, CASE WHEN json_valid(line) THEN regexp_replace(line, '\\s+', '', 'g') ELSE '' END FROM l WHERE trim(line) <> ''
UNION ALL SELECT path, 1, format, CASE WHEN format = 'scalar' THEN 'unsupported_json' ELSE '' END, CASE WHEN format = 'scalar' THEN '' ELSE regexp_replace(content, '\\s+', '', 'g') END FROM k WHERE format IN ('json_object', 'scalar')""",
)

_OUT = f"""{cte('raw', OUTCOMES)}, p AS (SELECT row_number, nullif(trim(event_id), '') AS event_id, CASE WHEN regexp_full_match(hidden_CAR_1_5, '[+-]?(\\d+\\.?\\d*|\\.\\d+)') THEN CAST(hidden_CAR_1_5 AS DOUBLE) END AS car, nullif(trim(hidden_valence), '') AS valence FROM raw),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY row_number) AS rk FROM p)"""
_add("hidden_outcome_rows", lambda s, d: I.hidden_outcomes(view(s, d, OUTCOMES))[0], f"WITH {_OUT} SELECT event_id, car AS CAR_1_5, valence AS hidden_valence, row_number FROM r WHERE event_id IS NOT NULL AND rk = 1")
_add("hidden_outcome_warnings", lambda s, d: I.hidden_outcomes(view(s, d, OUTCOMES).drop("hidden_valence"))[1], f"""WITH {_OUT} SELECT 'missing_event_id' AS code, event_id, row_number FROM r WHERE event_id IS NULL UNION ALL SELECT 'duplicate_event_id', event_id, row_number FROM r WHERE event_id IS NOT NULL AND rk > 1
UNION ALL SELECT 'missing_hidden_valence_column', NULL, NULL""")
_META = "SELECT c_custkey AS row_number, CASE WHEN c_custkey % 31 = 0 THEN 'evt_2' ELSE 'evt_' || c_custkey END AS event_id, c_name AS ticker, ' ' || c_mktsegment AS sector, CASE WHEN c_acctbal >= 5000 THEN 'large_cap' WHEN c_acctbal < 0 THEN '' ELSE 'small_mid_cap' END AS market_cap_group FROM {customer}"
_add("event_metadata_rows", lambda s, d: I.event_metadata(view(s, d, _META))[0], f"""WITH {cte('raw', _META)}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY row_number) AS rk FROM raw)
SELECT event_id, ticker, trim(sector) AS sector, nullif(market_cap_group, '') AS market_cap_group, true AS event_metadata_joined FROM r WHERE rk = 1""")
_UNITS = f"""{cte('banks', BANKS)}, bu AS (SELECT json_extract_string(value, '$.event_id') AS event_id, unnest(json_extract(value, '$.evidence_units[*]')) AS u, generate_subscripts(json_extract(value, '$.evidence_units[*]'), 1) - 1 AS n FROM banks),
bc AS (SELECT event_id, n, u, coalesce({_text('category', 'u')}, {_text('evidence_category', 'u')}) AS category, {_list('source_ids', 'u')} AS ids FROM bu)"""
_BANK = f"""{_UNITS}, bi AS (SELECT event_id, source_id, list_sort(list_distinct(list(category))) AS categories FROM (SELECT event_id, category, unnest(ids) AS source_id FROM bc WHERE category IS NOT NULL) GROUP BY ALL)"""
_add("bank_index", lambda s, d: I.bank_index(view(s, d, BANKS)).withColumn("categories", F.array_join("categories", ",")), f"WITH {_BANK} SELECT event_id, source_id, array_to_string(categories, ',') AS categories FROM bi")
_PACK = f"""{cte('packets', PACKETS)}, pu AS (SELECT json_extract_string(value, '$.event_id') AS event_id, unnest(json_extract(value, '$.source_units[*]')) AS u, 'section' AS f FROM packets UNION ALL SELECT json_extract_string(value, '$.event_id'), unnest(json_extract(value, '$.xbrl_facts[*]')), 'xbrl' FROM packets),
px AS (SELECT event_id, {_text('source_id', 'u')} AS source_id, f || ':' || CASE f WHEN 'section' THEN {_text('section', 'u')} ELSE {_text('tag', 'u')} END AS category FROM pu),
pi AS (SELECT event_id, source_id, list_sort(list_distinct(list(category))) AS categories FROM px WHERE category IS NOT NULL GROUP BY ALL)"""
_add("packet_index", lambda s, d: I.packet_index(view(s, d, PACKETS)).withColumn("categories", F.array_join("categories", ",")), f"WITH {_PACK} SELECT event_id, source_id, array_to_string(categories, ',') AS categories FROM pi")
_add("bank_summary", lambda s, d: I.bank_summary(view(s, d, BANKS)), f"""WITH {_UNITS}, v AS (SELECT event_id, n, {_text('category', 'u')} AS category, {_text('evidence_id', 'u')} AS evidence_id, len(regexp_extract_all(coalesce({_text('claim', 'u')}, ''), '[A-Za-z0-9]+(?:[._%/-][A-Za-z0-9]+)*')) AS tokens, list_filter(ids, lambda x: regexp_full_match(x, '[SX]\\d{{3,4}}')) AS ids FROM bc),
w AS (SELECT event_id, source_id, arg_max(category, n) AS category, count(DISTINCT evidence_id) AS units FROM (SELECT event_id, n, category, evidence_id, unnest(ids) AS source_id FROM v) GROUP BY ALL),
x AS (SELECT event_id, string_agg(source_id, ',' ORDER BY source_id) AS valid_source_ids, count(DISTINCT category) AS source_categories, max(units) AS most_units_of_a_source FROM w GROUP BY ALL),
y AS (SELECT event_id, count(*) AS unit_count, count(DISTINCT category) AS category_count, CAST(sum(tokens) AS BIGINT) AS token_count FROM v GROUP BY ALL) SELECT y.*, valid_source_ids, source_categories, most_units_of_a_source FROM y LEFT JOIN x USING (event_id)""")
for _name, _index, _sql in (("bank", "evidence_bank", _BANK), ("packet", "source_packet", _PACK)):
    _add(
        f"resolved_categories_{_name}",
        lambda s, d, n=_name: I.resolved_categories(decisions(s, d), I.bank_index(view(s, d, BANKS)) if n == "bank" else None, I.packet_index(view(s, d, PACKETS))).select("row_number", F.array_join("categories", ",").alias("categories"), "source", F.round("coverage", 6).alias("coverage")),
        f"""WITH {NORMAL}, {_sql}, c AS (SELECT row_number, event_id, unnest(list_distinct(evidence_used)) AS source_id FROM norm WHERE code IS NULL AND coalesce(len(own_categories), 0) = 0),
g AS (SELECT row_number, list_sort(list_distinct(flatten(list(coalesce(x.categories, []))))) AS categories, count(x.categories) * 1.0 / count(*) AS coverage FROM c LEFT JOIN {_name[0]}i x ON x.event_id = c.event_id AND x.source_id = c.source_id GROUP BY row_number)
SELECT row_number, array_to_string(list_sort(list_distinct(own_categories)), ',') AS categories, 'decision_record' AS source, 1.0::DOUBLE AS coverage FROM norm WHERE code IS NULL AND len(own_categories) > 0
UNION ALL SELECT row_number, array_to_string(categories, ','), '{_index}', round(coverage::DOUBLE, 6) FROM g""",
    )

_ANS = f"""{cte('answers', ANSWERS)}, t AS (SELECT ordinal, trim(value, ' ' || chr(10)) AS t, list_concat([trim(value, ' ' || chr(10))], regexp_extract_all(value, '(?is)```(?:json)?\\s*(.*?)```', 1), [regexp_extract(value, '(?s)\\{{.*\\}}')]) AS tries FROM answers),
o AS (SELECT ordinal, CAST(list_filter(tries, lambda x: json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x ELSE 'null' END) = 'OBJECT')[1] AS JSON) AS j FROM t),
q AS (SELECT ordinal, j, {_number('expected_return_5d')} AS er, {_number('confidence')} AS co, {_number('action_strength')} AS st, lower({_text('action')}) AS action, {_list('key_reasons')} AS kl, {_text('key_reasons')} AS kt, {_list('evidence_used')} AS el, {_text('evidence_used')} AS et FROM o),
r AS (SELECT *, CASE WHEN len(kl) > 0 THEN kl WHEN kt IS NULL THEN ['No reason was given.', 'No external information was used.'] WHEN json_valid(kt) AND kt[1] = '[' THEN CAST(CAST(CASE WHEN json_valid(kt) THEN kt ELSE '[]' END AS JSON) AS VARCHAR[]) WHEN contains(kt, chr(10)) THEN list_transform(string_split(kt, chr(10)), lambda x: trim(regexp_replace(x, '^[-*•]', ''))) ELSE [kt] END AS k,
  CASE WHEN len(list_filter(el, lambda x: regexp_full_match(x, '[SX]\\d{{3}}'))) > 0 THEN list_filter(el, lambda x: regexp_full_match(x, '[SX]\\d{{3}}')) WHEN len(regexp_extract_all(coalesce(et, ''), '\\b[SX]\\d{{3}}\\b')) > 0 THEN regexp_extract_all(et, '\\b[SX]\\d{{3}}\\b') ELSE ['S001'] END AS e FROM q)"""
_add("output_records", lambda s, d: I.output_record(view(s, d, ANSWERS)), f"""WITH {_ANS} SELECT ordinal, j IS NOT NULL AS recovered, round(greatest(-0.2, least(0.2, er)), 4) AS expected_return_5d, round(greatest(0.0, least(1.0, co)), 4) AS confidence, action, round(greatest(-1.0, least(1.0, st)), 4) AS action_strength,
  CASE WHEN j IS NOT NULL THEN array_to_string(CASE WHEN len(k) < 2 THEN list_concat(k, ['No second reason was given.']) ELSE k[1:5] END, '|') END AS key_reasons,
  CASE WHEN j IS NOT NULL THEN array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ',') END AS evidence_used FROM r""")

_ALIAS = {"m1": "model-one"}
_add("canonicalised_records", lambda s, d: I.canonicalised(decisions(s, d).withColumn("request_key", F.when(F.col("row_number") % 3 == 0, F.concat_ws("|", *I.KEY_FIELDS)).when(F.col("row_number") % 3 == 1, "old")), _ALIAS).select("row_number", "model_family", "request_key", "repaired"), f"""WITH {NORMAL}, a AS (SELECT *, grp AS profile_group2, concat_ws('|', event_id, treatment, profile, grp, model_family, representation_seed, decision_seed) AS k0,
  CASE model_family WHEN 'm1' THEN 'model-one' ELSE model_family END AS mf FROM norm WHERE code IS NULL), b AS (SELECT *, concat_ws('|', event_id, treatment, profile, grp, mf, representation_seed, decision_seed) AS k1, CASE row_number % 3 WHEN 0 THEN k0 WHEN 1 THEN 'old' END AS k9 FROM a)
SELECT row_number, mf AS model_family, k1 AS request_key, concat_ws(',', CASE WHEN mf <> model_family THEN 'model_family' END, CASE WHEN k1 IS DISTINCT FROM k9 THEN 'request_key' END) AS repaired FROM b""")
_add("request_keys", lambda s, d: decisions(s, d).select("row_number", I.request_key().alias("long_key"), I.request_key(upstream=False).alias("short_key")), f"WITH {NORMAL} SELECT row_number, concat_ws('|', event_id, treatment, upstream_model_family, profile, grp, model_family, representation_seed, decision_seed) AS long_key, concat_ws('|', event_id, treatment, profile, grp, model_family, representation_seed, decision_seed) AS short_key FROM norm WHERE code IS NULL")
_LISTS = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '["S001", "' || c_name || '"]' WHEN 1 THEN '[''S002'', ''' || c_name || ''']' WHEN 2 THEN '[]' WHEN 3 THEN 'plain' ELSE NULL END AS c FROM {customer}"""
_add("list_columns", lambda s, d: view(s, d, _LISTS).select("id", F.coalesce(F.array_join(I.list_column(F.col("c")), "|"), F.lit("none")).alias("items")), f"WITH {cte('l', _LISTS)} SELECT id, CASE id % 5 WHEN 0 THEN 'S001|' || split_part(c, '\"', 4) WHEN 1 THEN 'S002|' || split_part(c, chr(39), 4) WHEN 2 THEN '' ELSE 'none' END AS items FROM l")
_PRICES = "SELECT ' u' || user_id AS ticker, substr(CAST(ts AS STRING), 1, 10) AS \"DATE\", CASE WHEN event_id % 13 = 0 THEN 'nan' ELSE '' || (event_id % 997) || '.25' END AS close FROM {events}"
_add("price_panel", lambda s, d: I.price_panel(view(s, d, _PRICES.replace('"DATE"', "`DATE`"))), f"WITH {cte('p', _PRICES)} SELECT upper(trim(ticker)) AS ticker, CAST(\"DATE\" AS DATE) AS date, CAST(close AS DOUBLE) AS price FROM p WHERE close <> 'nan'")
_UNI = "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'tick' || CAST(floor(c_custkey / 4.0) AS BIGINT) ELSE ' TICK' || CAST(floor(c_custkey / 4.0) AS BIGINT) END AS ticker, CASE WHEN c_custkey % 44 = 1 THEN 'other' ELSE 'tech' END AS sector, 'large_cap' AS market_cap_group FROM {customer}"
_add("universe", lambda s, d: I.universe(view(s, d, _UNI)), f"WITH {cte('u', _UNI)} SELECT upper(trim(ticker)) AS ticker, min(sector) AS sector, min(market_cap_group) AS market_cap_group, count(DISTINCT sector || market_cap_group) > 1 AS conflict FROM u GROUP BY 1")
_FIL = "SELECT o_orderkey AS ordinal, o_custkey AS cik, 'a' || (o_orderkey % 5000) AS accession, CAST(o_orderdate AS DATE) AS filing_date FROM {orders}"
_add("latest_filings", lambda s, d: I.latest_filings(view(s, d, _FIL), "1993-01-01", "1995-12-31"), f"WITH {cte('f', _FIL)}, r AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY ordinal DESC) AS rk FROM f WHERE filing_date BETWEEN DATE '1993-01-01' AND DATE '1995-12-31') SELECT * EXCLUDE (rk) FROM r WHERE rk = 1")
_PAGES = "SELECT o_custkey AS page, min(CAST(o_orderdate AS DATE)) AS filing_from, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE max(CAST(o_orderdate AS DATE)) END AS filing_to FROM {orders} GROUP BY o_custkey"
_add("pages_in_range", lambda s, d: I.pages_in_range(view(s, d, _PAGES), "1997-06-01", "1998-01-31"), f"WITH {cte('p', _PAGES)} SELECT * FROM p WHERE (filing_to IS NULL OR filing_to >= DATE '1997-06-01') AND filing_from <= DATE '1998-01-31'")
_EXH = "SELECT CAST(floor(page_id / 4.0) AS BIGINT) AS filing, page_id AS ordinal, CASE page_id % 4 WHEN 0 THEN '8-K' WHEN 1 THEN 'EX-99.2' ELSE 'ex-99.1' END AS type, 'f' || (page_id % 4) || '.htm' AS filename, url AS text, CASE WHEN page_id % 8 < 4 THEN 'http://x/y/F2.HTM/' ELSE 'http://x/none.htm' END AS wanted FROM {pages}"
_add("exhibit_texts", lambda s, d: I.exhibit_of(view(s, d, _EXH), "filing", "wanted"), f"WITH {cte('e', _EXH)}, r AS (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY lower(filename) <> CASE WHEN ordinal % 8 < 4 THEN 'f2.htm' ELSE 'none.htm' END, ordinal) AS rk FROM e WHERE upper(type) LIKE 'EX-99%' AND text IS NOT NULL) SELECT filing, upper(type) AS type, filename, text FROM r WHERE rk = 1")
_REND = "SELECT 'f' || (conv_id % 5) AS path, conv_id * 10 + turn AS ordinal, chr(123) || '\"event_id\": \"e' || conv_id || '\", \"treatment\": \"T2\"' || CASE WHEN turn % 3 = 0 THEN '' ELSE ', \"rendered_text\": \"line ' || turn || '\"' END || chr(125) AS value FROM {conversations}"
_add("rendered_rows", lambda s, d: I.rendered(view(s, d, _REND)), f"WITH {cte('r', _REND)} SELECT path, ordinal AS line, value ->> '$.event_id' AS event_id, value ->> '$.treatment' AS treatment, value ->> '$.rendered_text' AS rendered_text FROM r WHERE contains(value, 'rendered_text')")
_add("addressed_lines", lambda s, d: I.lines_at(view(s, d, _REND), A.table(s, d, "customer").select(F.concat(F.lit("f"), (F.col("c_custkey") % 7).cast("string"), F.lit(":"), F.col("c_custkey").cast("string")).alias("address"))), f"WITH {cte('r', _REND)}, w AS (SELECT 'f' || (c_custkey % 7) AS path, c_custkey AS n FROM customer) SELECT w.path || ':' || n AS address, value FROM w JOIN r ON r.path = w.path AND r.ordinal = w.n")
_CACHE = "SELECT c_custkey AS cik, CASE WHEN c_custkey % 6 = 0 THEN 'broken' || chr(123) ELSE chr(123) || '\"facts\": ' || c_custkey || chr(125) END AS content FROM {customer}"
_add("company_facts", lambda s, d: I.facts_of(view(s, d, _CACHE)).select("cik", F.try_variant_get("facts", "$.facts", "bigint").alias("fact")), f"WITH {cte('c', _CACHE)} SELECT cik, CASE WHEN json_valid(content) THEN CAST(content ->> '$.facts' AS BIGINT) END AS fact FROM c")
