"""Queries of packets, screening, rendering and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import audit
from tessella.operators import briefs as B
from tessella.operators import experiment as E
from tessella.plans.intake import NORMAL, RAW, cte, decisions, records, view
from tessella.plans.registry import _add
from tessella.sources import adapters as A
from tessella.sources import intake as I


def _docs(s, d):
    return A.table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_T = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _case(table: dict, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(k)} THEN '{v}'" for k, v in table.items()) + " ELSE"


_SECTION = lambda t: "CASE " + " ".join(f"WHEN regexp_matches(lower({t}), '{p}') THEN '{n}'" for n, p in B.SECTIONS.items()) + " ELSE 'general' END"
_SKIP = lambda t: f"(length({t}) < 35 OR (length({t}) < 65 AND NOT regexp_matches({t}, '[0-9.:%]') AND len(regexp_split_to_array(trim({t}), '\\s+')) <= 8) OR regexp_matches({t}, '(?i){B.BOILERPLATE}'))"
_DIRTY = lambda t: "concat_ws(';', " + ", ".join(f"CASE WHEN regexp_matches(lower(substr({t}, 1, 5000)), '{p}') THEN '{n}' END" for n, p in B.DIRTY.items()) + ")"
_CLUES = lambda t: "concat_ws('|', " + ", ".join(f"CASE WHEN contains(lower({t}), '{c.lower()}') THEN '{c}' END" for c in B.CLUES) + ")"
_SAID = "SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'Sales rose and ' WHEN 1 THEN 'We expect EPS and margin: ' WHEN 2 THEN 'Chapter 11 fraud investigation ' WHEN 3 THEN 'The cost of an iPhone or Azure ' WHEN 4 THEN 'Conference call ' WHEN 5 THEN 'debt ' WHEN 6 THEN 'risk ' WHEN 7 THEN 'backlog 5 ' ELSE '' END || CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS text FROM {conversations}"
_add("section_of_documents", lambda s, d: _docs(s, d).select("doc_id", B.section_of(F.col("text")).alias("section")), f"WITH {_T} SELECT doc_id, {_SECTION('t')} AS section FROM d")
_add("text_screens", lambda s, d: view(s, d, _SAID).select("conv_id", "turn", B.section_of(F.col("text")).alias("section"), B.skipped(F.col("text")).alias("skipped"), B.dirty_reasons(F.col("text")).alias("dirty"), B.leakage_clues(F.col("text")).alias("clues")), f"WITH {cte('c', _SAID)} SELECT conv_id, turn, {_SECTION('text')} AS section, {_SKIP('text')} AS skipped, {_DIRTY('text')} AS dirty, {_CLUES('text')} AS clues FROM c")
_TAGS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN ' Revenue and Sales' WHEN 1 THEN 'EPS outlook' WHEN 2 THEN 'Cash balance' WHEN 3 THEN p_type WHEN 4 THEN 'price risk' ELSE NULL END AS section, CASE p_partkey % 5 WHEN 0 THEN 'us-gaap:Net Income Loss' WHEN 1 THEN 'GrossProfit' WHEN 2 THEN 'Sales_Revenue_Net' WHEN 3 THEN p_brand ELSE NULL END AS tag FROM {part}"
_SEC = "CASE " + " ".join(f"WHEN contains(lower(trim(coalesce(section, ''))), '{k}') THEN '{v}'" for k, v in B.SECTION_CATEGORIES.items()) + " ELSE 'other' END"
_TAG = "CASE " + " ".join(f"WHEN contains(regexp_replace(lower(coalesce(tag, '')), '[^a-z0-9]', '', 'g'), '{k}') THEN '{v}'" for k, v in B.TAG_CATEGORIES.items()) + " ELSE 'other' END"
_add("inferred_categories", lambda s, d: s.sql(_TAGS, part=A.table(s, d, "part")).select("id", B.category_of_section(F.col("section")).alias("by_section"), B.category_of_tag(F.col("tag")).alias("by_tag")), f"WITH t AS ({_TAGS.replace('{part}', 'part')}) SELECT id, {_SEC} AS by_section, {_TAG} AS by_tag FROM t")
_add("letter_labels", lambda s, d: A.table(s, d, "part").select(F.col("p_partkey").alias("n"), B.letters(F.col("p_partkey")).alias("label")), "WITH RECURSIVE r AS (SELECT p_partkey AS n, p_partkey AS c, '' AS s FROM part UNION ALL SELECT n, CAST((c - 1) // 26 AS BIGINT), chr(CAST((c - 1) % 26 + 65 AS INTEGER)) || s FROM r WHERE c > 0) SELECT n, s AS label FROM r WHERE c = 0")
_PACKET = "SELECT conv_id, turn, 'x' || chr(10) || '- S00' || (conv_id % 9) || ' [general]: ' || text || chr(10) || '-  X01' || (turn % 9) || ' tag: 5' || chr(10) || '- S0123 [no]' || chr(10) || ' - S777 [no] see S00' || (turn % 9) || ' and S00' || (conv_id % 9) AS text FROM {conversations}"
_add("ids_in_packets", lambda s, d: view(s, d, _PACKET).select("conv_id", "turn", F.array_join(B.visible_ids(F.col("text")), ",").alias("visible"), F.array_join(B.three_digit_ids(F.col("text")), ",").alias("mentioned")), f"""WITH {cte('c', _PACKET)} SELECT conv_id, turn, 'S00' || (conv_id % 9) || ',X01' || (turn % 9) AS visible, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') AS mentioned FROM (SELECT *, regexp_extract_all(text, '\\b([SX]\\d{{3}})\\b', 1) AS x FROM c)""")
_add("reasoning_texts", lambda s, d: decisions(s, d).select("row_number", *[c.alias(n) for n, c in B.reasoning_texts(F.col("key_reasons"), F.when(F.col("row_number") % 2 == 0, F.col("evidence_used"))).items()]), f"""WITH {NORMAL}, x AS (SELECT row_number, array_to_string(key_reasons, chr(10)) AS r, CASE WHEN row_number % 2 = 0 THEN array_to_string(evidence_used, chr(10)) ELSE '' END AS u FROM norm WHERE code IS NULL)
SELECT row_number, r AS expressed_reason_text, u AS uncertainty_frame_text, concat_ws(chr(10) || chr(10), CASE WHEN r <> '' THEN 'Reasons:' || chr(10) || r END, CASE WHEN u <> '' THEN 'Uncertainty:' || chr(10) || u END) AS composite_reasoning_text FROM x""")

#: Units and metadata of packets; every seventh unit is not supported, every fifth has no value.
UNITS = """SELECT 'evt_' || CAST(floor(c_custkey / 3.0) AS BIGINT) AS event_id, c_custkey AS ordinal, 'E_SRC_' || lpad('' || (c_custkey % 3 + 1), 3, '0') AS evidence_id, CASE c_custkey % 4 WHEN 0 THEN 'guidance' WHEN 1 THEN 'revenue' WHEN 2 THEN 'zeta' ELSE 'margins' END AS category,
  'Sales | of ' || c_name || CASE WHEN c_custkey % 6 = 0 THEN ' conference call' ELSE ' rose' END AS claim, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '' || c_custkey END AS value, 'S' || lpad('' || (c_custkey % 500), 3, '0') AS one, CASE WHEN c_custkey % 2 = 0 THEN 'Sales | of ' || c_name || ' rose' ELSE 'quote' END AS source_quote,
  CASE WHEN c_custkey % 7 = 0 THEN 'weak' ELSE 'supported' END AS support_label FROM {customer}"""
META = """SELECT 'evt_' || c_custkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS company_name, CASE WHEN c_custkey % 6 = 0 THEN 'Alias' ELSE NULL END AS company_alias, CAST(NULL AS STRING) AS masked_company, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'T' || c_custkey END AS ticker, '2024-01-0' || (c_custkey % 9) AS event_date, c_mktsegment AS sector,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'large_cap' END AS market_cap_group, CAST(NULL AS STRING) AS fiscal_period, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-01T09:00:00' ELSE NULL END AS accepted_at, CASE WHEN c_custkey % 3 = 1 THEN '2.02, 9.01' ELSE '' END AS items,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE c_custkey % 7 END AS ret_5d, CAST(NULL AS INT) AS ret_20d, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 3 END AS market_ret_20d FROM {customer}"""


def units(s, d):
    return view(s, d, UNITS).withColumn("source_ids", F.array("one")).drop("one")


def meta(s, d):
    return view(s, d, META)


_HEAD = "list_filter(['Entity: ' || coalesce(company_name, company_alias, 'Company ' || split_part(event_id, '_', 2)), CASE WHEN ticker <> '' THEN 'Ticker: ' || ticker END, 'Event date: ' || event_date, 'Sector: ' || sector, 'Market cap group: ' || market_cap_group], lambda x: x IS NOT NULL)"
UM = f"{cte('u', UNITS)}, {cte('mt', META)}, m AS (SELECT *, {_HEAD} AS head FROM mt)"
_ONE = """'{"category":"' || category || '","claim":"' || claim || '","evidence_id":"' || evidence_id || '","source_ids":["' || one || '"],"support_label":"' || support_label || '","value":' || coalesce('"' || value || '"', 'null') || '}'"""
_add("canonical_units", lambda s, d: B.canonical_units(units(s, d)), f"WITH {UM} SELECT event_id, ordinal, {_ONE} AS unit FROM u")
_add("bank_hashes", lambda s, d: B.bank_hashes(units(s, d)), f"WITH {UM}, j AS (SELECT event_id, ordinal, {_ONE} AS unit FROM u) SELECT event_id, count(*) AS unit_count, sha256(string_agg(unit, chr(10) ORDER BY ordinal)) AS ordered_sha256, sha256(string_agg(unit, chr(10) ORDER BY unit)) AS unordered_sha256 FROM j GROUP BY 1")
_add("bank_text", lambda s, d: B.bank_text(meta(s, d), units(s, d)), f"WITH {UM}, j AS (SELECT event_id, string_agg({_ONE}, chr(10) ORDER BY ordinal) AS l FROM u GROUP BY 1) SELECT m.event_id, 'Event metadata:' || chr(10) || array_to_string(head, chr(10)) || chr(10) || chr(10) || 'Canonical evidence-unit bank:' || chr(10) || l AS rendered_text FROM m JOIN j USING (event_id)")
_RULES = ["Use only the supplied units.", "Cite source IDs only."]
_LONG = """'{"category":"' || category || '","claim":"' || claim || '","evidence_id":"' || evidence_id || '","source_ids":["' || one || '"],"source_quote":"' || source_quote || '","support_label":"' || support_label || '","value":' || coalesce('"' || value || '"', 'null') || '}'"""
_add("summary_prompts", lambda s, d: B.summary_prompt(meta(s, d), units(s, d), "T2_shared", _RULES, [0, 1]), f"WITH {UM}, j AS (SELECT event_id, string_agg({_LONG}, chr(10) ORDER BY ordinal) AS l FROM u GROUP BY 1), q AS (SELECT m.*, l, unnest([0, 1]) AS representation_seed FROM m JOIN j USING (event_id)) SELECT event_id, representation_seed, 'Treatment: T2_shared' || chr(10) || 'Representation seed: ' || representation_seed || chr(10) || chr(10) || 'Rules:' || chr(10) || '- {_RULES[0]}' || chr(10) || '- {_RULES[1]}' || chr(10) || chr(10) || 'Event metadata:' || chr(10) || array_to_string(list_transform(head, lambda x: '- ' || x), chr(10)) || chr(10) || chr(10) || 'Canonical evidence-unit bank:' || chr(10) || l || chr(10) AS prompt FROM q")
_CAT = "coalesce(nullif(list_position([" + ", ".join(f"'{c}'" for c in B.CATEGORY_ORDER) + f"], category), 0), {len(B.CATEGORY_ORDER) + 1})"
_LEDGER = lambda line, heading, columns: f"""WITH {UM}, k AS (SELECT *, bool_and(support_label = 'supported') OVER (PARTITION BY event_id) AS every, {_CAT} AS place_, row_number() OVER (PARTITION BY event_id, category ORDER BY evidence_id) AS rn FROM u),
l AS (SELECT event_id, count(*) AS n, any_value({columns}) AS c, string_agg(CASE WHEN rn = 1 THEN '{heading}' || category || chr(10) ELSE '' END || {line}, chr(10) ORDER BY place_, category, evidence_id) AS l FROM k GROUP BY 1)
SELECT event_id, head[1] || chr(10) || 'Event: ' || event_id || chr(10) || 'Canonical evidence units included: ' || n || chr(10) || c || replace(l, '~', chr(10)) AS rendered_text FROM m JOIN l USING (event_id)"""  # noqa: E731
_add("ledger_bullets", lambda s, d: B.ledger_bullets(meta(s, d), units(s, d)), _LEDGER("concat_ws(chr(10), '- evidence_id: ' || evidence_id, '  category: ' || category, '  claim: ' || claim, '  value: ' || value, '  source_ids: [' || one || ']', '  support_label: ' || support_label, '  source_quote: ' || source_quote)", "## ", "''"))
_add("ledger_rows", lambda s, d: B.ledger_rows(meta(s, d), units(s, d)), _LEDGER("concat_ws(' | ', evidence_id, one, replace(claim, '|', chr(92) || '|'), coalesce(value, ''), CASE WHEN NOT every THEN support_label END, replace(CASE WHEN source_quote = claim THEN 'SAME_AS_CLAIM' ELSE source_quote END, '|', chr(92) || '|'))", "~## Category: ", "CASE WHEN every THEN 'Support label default: supported for all rows.' || chr(10) || 'Columns: Evidence ID | Source IDs | Claim | Value | Source quote' || chr(10) ELSE 'Columns: Evidence ID | Source IDs | Claim | Value | Support | Source quote' || chr(10) END"))
_add("evidence_order", lambda s, d: B.evidence_order(units(s, d), ["rose", "sales"]).select("event_id", "evidence_id", "place"), f"WITH {UM} SELECT event_id, evidence_id, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN contains(claim, 'conference call') THEN 1 ELSE 0 END, -(CASE WHEN contains(claim, 'rose') THEN 1 ELSE 0 END), one, length(claim), ordinal) AS place FROM u")
_packet = lambda s, d: (meta(s, d), units(s, d).select("event_id", "ordinal", F.col("source_ids")[0].alias("source_id"), F.col("category").alias("section"), F.col("claim").alias("text")), units(s, d).where("ordinal % 3 = 1").select("event_id", "ordinal", F.lit("X001").alias("source_id"), F.lit("Revenues").alias("tag"), "value", F.when(F.col("ordinal") % 2 == 0, "USD").alias("unit")))
_add("packet_text", lambda s, d: B.packet_text(*_packet(s, d)), f"""WITH {UM}, a AS (SELECT event_id, string_agg('- ' || one || ' [' || category || ']: ' || claim, chr(10) ORDER BY ordinal) AS src, string_agg(rtrim('- X001 Revenues: ' || coalesce(value, 'None') || ' ' || CASE WHEN ordinal % 2 = 0 THEN 'USD' ELSE '' END), chr(10) ORDER BY ordinal) FILTER (ordinal % 3 = 1) AS fac FROM u GROUP BY 1)
SELECT m.event_id, concat_ws(chr(10) || chr(10), array_to_string(list_concat(head, list_filter(['Accepted at ET: ' || accepted_at, 'Items: ' || nullif(items, '')], lambda x: x IS NOT NULL)), chr(10)), 'Source evidence:' || chr(10) || src, 'Structured facts:' || chr(10) || fac,
  'Pre-event price context:' || chr(10) || nullif(concat_ws(chr(10), '- ret_5d: ' || ret_5d, '- market_ret_20d: ' || market_ret_20d), '')) AS rendered_text FROM m LEFT JOIN a USING (event_id)""")
_PROFILES = "SELECT n_name AS profile, CASE WHEN n_nationkey < 12 THEN 'retail' ELSE 'institutional' END AS profile_group, 'days' AS horizon, 'a, b' AS focus, 'brief' AS style FROM {nation} WHERE n_nationkey < 6"
_REN = "SELECT 'evt_' || o_orderkey AS event_id, 'T2' AS treatment, 'u0' AS upstream_model_family, o_orderkey % 3 AS representation_seed, CASE WHEN o_orderkey % 4 = 0 THEN 'BRAZIL' ELSE NULL END AS profile_id, 'text ' || o_orderkey AS rendered_text FROM {orders} WHERE o_orderkey % 5 = 0"
_add("downstream_prompts", lambda s, d: B.downstream_prompts(view(s, d, _REN), s.sql(_PROFILES, nation=A.table(s, d, "nation")), [1, 2], "Decide.\n"), f"""WITH {cte('r', _REN)}, p AS ({_PROFILES.replace('{nation}', 'nation')}), x AS (SELECT r.*, p.*, unnest([1, 2]) AS decision_seed FROM r JOIN p ON profile_id IS NULL OR profile_id = profile)
SELECT event_id, profile, decision_seed, 'downstream:u0:' || event_id || ':T2:' || representation_seed || ':' || coalesce(profile_id, 'shared') AS cache_key, 'Decide.' || chr(10) || 'Treatment packet:' || chr(10) || rendered_text || chr(10) || chr(10) || 'Investor profile and seed:' || chr(10) || 'Profile: ' || profile || chr(10) || 'Profile group: ' || profile_group || chr(10) || 'Horizon: days' || chr(10) || 'Focus: a, b' || chr(10) || 'Style: brief' || chr(10) || 'Decision seed: ' || decision_seed || chr(10) AS prompt FROM x""")
_CITE = "SELECT 'evt_' || (o_orderkey % 600) AS event_id, o_orderkey AS row, CASE o_orderkey % 3 WHEN 0 THEN 'See E_SRC_001 and E_SRC_002.' WHEN 1 THEN 'E_XBRL_001 none' ELSE 'no ids' END AS text FROM {orders}"
_add("cited_by_source", lambda s, d: B.cited_by_source(view(s, d, _CITE), units(s, d)), f"""WITH {UM}, {cte('c', _CITE)}, k AS (SELECT event_id, any_value(one) FILTER (evidence_id = 'E_SRC_001') AS a, any_value(one) FILTER (evidence_id = 'E_SRC_002') AS b FROM u GROUP BY 1)
SELECT c.event_id, row, replace(replace(text, 'E_SRC_001', coalesce(a, 'E_SRC_001')), 'E_SRC_002', coalesce(b, 'E_SRC_002')) AS text, CASE WHEN row % 3 = 0 THEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT ELSE 0 END::BIGINT AS replacements FROM c LEFT JOIN k USING (event_id)""")
_BLOCKS = "SELECT 'evt_' || CAST(floor(conv_id / 2.0) AS BIGINT) AS event_id, conv_id * 100 + turn AS ordinal, 'Heading' AS heading, CASE WHEN turn % 4 = 3 THEN 'This is one sentence about revenue of ' || (conv_id % 2) || ' dollars.' WHEN turn % 4 = 2 THEN 'Before. This is one sentence about revenue of ' || (conv_id % 2) || ' dollars. After that it is longer.' ELSE text END AS text FROM {conversations}"
_add("source_units", lambda s, d: B.source_units(view(s, d, _BLOCKS)))
_EXH = "SELECT CAST(floor(page_id / 3.0) AS BIGINT) AS filing, CASE page_id % 3 WHEN 0 THEN 'EX-99.1' WHEN 1 THEN 'ex-99.2' ELSE 'EX-99.1' END AS type, CASE WHEN page_id % 4 = 0 THEN 'a' || page_id || '.pdf' WHEN page_id % 4 = 1 THEN 'ex99.1-' || page_id || '.htm' ELSE 'b' || page_id || '.htm' END AS filename, CASE WHEN page_id % 5 = 0 THEN 'Earnings' ELSE '' END AS description, url AS text FROM {pages}"
_SCORE = "(CASE WHEN upper(type) = 'EX-99.1' THEN 100 ELSE 0 END + CASE WHEN contains(lower(filename), '99.1') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(lower(upper(type) || ' ' || filename || ' ' || description), 'earn|result|release|quarter') THEN 25 ELSE 0 END - CASE WHEN filename LIKE '%.pdf' THEN 200 ELSE 0 END)"
_add("chosen_exhibits", lambda s, d: B.choose_exhibit(view(s, d, _EXH), "filing"), f"WITH {cte('e', _EXH)}, r AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY filing ORDER BY {_SCORE} DESC, filename DESC) AS rk FROM e) SELECT filing, upper(type) AS type, filename, score FROM r WHERE rk = 1")
_GAPS = "SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'evt_' || lpad('' || (o_orderkey % 900 + 1), 4, '0') WHEN o_orderkey % 4 = 1 THEN 'other' || o_orderkey ELSE NULL END AS event_id, o_orderkey FROM {orders} WHERE o_orderkey < 1500"
_add("assigned_ids", lambda s, d: B.assigned_ids(view(s, d, _GAPS), "o_orderkey"), f"WITH {cte('g', _GAPS)}, f AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM range(1, 5000) t(n) WHERE 'evt_' || lpad('' || n, 4, '0') NOT IN (SELECT event_id FROM g WHERE event_id IS NOT NULL)), l AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM g WHERE event_id IS NULL) SELECT 'evt_' || lpad('' || n, 4, '0') AS event_id, o_orderkey FROM l JOIN f USING (k) UNION ALL SELECT event_id, o_orderkey FROM g WHERE event_id IS NOT NULL")
_FORMS = "SELECT o_custkey AS cik, CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '6-K' ELSE '20-F' END ELSE CASE o_orderkey % 4 WHEN 0 THEN '10-k' WHEN 1 THEN '8-K/A' WHEN 2 THEN 'S-1' ELSE NULL END END AS form, CASE WHEN o_orderkey % 3 = 0 THEN '2.02,9.01' WHEN o_orderkey % 3 = 1 THEN '5.02' ELSE NULL END AS items FROM {orders}"
_add("company_screen", lambda s, d: B.company_screen(view(s, d, _FORMS)), f"WITH {cte('f', _FORMS)}, g AS (SELECT cik, list_sort(list(DISTINCT upper(coalesce(form, '')))) AS x FROM f GROUP BY 1) SELECT cik, list_has_any(x, ['10-K', '10-Q', '8-K', '8-K/A']) AS domestic_reporting, list_contains(x, '6-K') AND NOT list_has_any(x, ['10-K', '10-Q', '8-K']) AS fpi_like, list_has_any(x, ['8-K', '8-K/A']) AS has_8k, array_to_string(list_filter(x, lambda y: y <> ''), ';') AS forms_seen FROM g")
_add("item_2_02", lambda s, d: view(s, d, _FORMS).groupBy("cik").agg(F.count_if(B.item_2_02(F.col("items"))).alias("n")), f"WITH {cte('f', _FORMS)} SELECT cik, count(*) FILTER (contains(items, '2.02')) AS n FROM f GROUP BY 1")
_SCREEN = f"SELECT conv_id * 100 + turn AS accession, CASE WHEN turn % 7 = 6 THEN NULL ELSE text END AS text, CASE WHEN conv_id % 11 = 0 THEN NULL ELSE 'EX-99.1' END AS exhibit_type, conv_id % 13 = 0 AS is_image, length(text) AS tokens, turn % 3 <> 0 AS price_ok, conv_id % 5 <> 0 AS xbrl_ok, conv_id % 7 <> 0 AS has_item_2_02 FROM ({_SAID}) x"
_SREAD = "(text IS NOT NULL AND exhibit_type IS NOT NULL AND NOT is_image)"
_SCR = f"""{cte('sc', _SCREEN)}, z AS (SELECT *, tokens >= 60 AS po, {_CLUES('text')} AS cl, {_DIRTY('text')} AS di FROM sc),
scr AS (SELECT *, {_SREAD} AND po AS parse_ok, {_SREAD} AND po AND cl = '' AND tokens <= 300 AS masking_ok, CASE WHEN text IS NULL THEN 'filing_text_fetch_failed' WHEN exhibit_type IS NULL THEN 'no_exhibit_99_x' WHEN is_image THEN 'exhibit_only_pdf_or_image_without_clean_text' ELSE
  array_to_string(list_sort(list_distinct(list_filter(list_concat([CASE WHEN NOT po THEN 'unparseable_exhibit' END, CASE WHEN tokens > 300 THEN 'source_text_over_token_budget' END, CASE WHEN cl <> '' THEN 'packet_contains_unmaskable_unique_identifiers' END, CASE WHEN NOT price_ok THEN 'no_valid_price_window' END], string_split(di, ';')), lambda x: x IS NOT NULL AND x <> ''))), ';') END AS exclusion_reason FROM z)"""
_screen = lambda s, d: B.screening(view(s, d, _SCREEN), 60, 300, True)
_add("screening_rows", lambda s, d: _screen(s, d).select("accession", "parse_ok", "masking_ok", "exclusion_reason"), f"WITH {_SCR} SELECT accession, coalesce(parse_ok, false) AS parse_ok, coalesce(masking_ok, false) AS masking_ok, exclusion_reason FROM scr")
_add("eligible_candidates", lambda s, d: B.eligible(_screen(s, d), True).select("accession"), f"WITH {_SCR} SELECT accession FROM scr WHERE exclusion_reason = '' AND parse_ok AND xbrl_ok AND has_item_2_02 AND masking_ok AND price_ok")
_CAND = "SELECT o_orderkey AS accession, o_custkey AS issuer, CASE WHEN o_custkey % 3 = 0 THEN 'large_cap' WHEN o_custkey % 3 = 1 THEN 'small_mid_cap' ELSE 'other' END AS cap_group, o_orderpriority AS sector, o_orderstatus AS valence, CAST(o_orderdate AS DATE) AS accepted FROM {orders}"
_pick = lambda s, d: B.stratified(view(s, d, _CAND), {"large_cap": 50, "small_mid_cap": 31}, ["valence", "sector"], [F.desc("accepted")])
_PICK = f"""{cte('ca', _CAND)}, t AS (SELECT *, CASE cap_group WHEN 'large_cap' THEN 50 WHEN 'small_mid_cap' THEN 31 END AS target FROM ca WHERE cap_group <> 'other'), v AS (SELECT *, dense_rank() OVER (PARTITION BY cap_group ORDER BY valence || '|' || sector) - 1 AS slot FROM t),
w AS (SELECT *, max(slot) OVER (PARTITION BY cap_group) + 1 AS parts, row_number() OVER (PARTITION BY cap_group, valence, sector ORDER BY accepted DESC, accession) AS own FROM v), x AS (SELECT *, own <= target // parts + CASE WHEN slot < target % parts THEN 1 ELSE 0 END AS ins FROM w),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cap_group ORDER BY ins DESC, accepted DESC, accession) AS place FROM x) WHERE place <= target)"""
_add("stratified_candidates", lambda s, d: _pick(s, d).select("accession", "cap_group", "valence", "sector", "in_share"), f"WITH {_PICK} SELECT accession, cap_group, valence, sector, ins AS in_share FROM pk")
_add("selection_summary", lambda s, d: B.selection_summary(view(s, d, _CAND), _pick(s, d)), f"WITH {_PICK}, e AS (SELECT cap_group, count(*) AS eligible, count(DISTINCT issuer) AS issuers FROM ca GROUP BY 1), f AS (SELECT cap_group, count(*) AS selected, count(DISTINCT sector) AS sectors FROM pk GROUP BY 1) SELECT e.*, coalesce(selected, 0) AS selected, coalesce(sectors, 0) AS sectors FROM e LEFT JOIN f USING (cap_group)")
_add("first_rows", lambda s, d: B.first_rows(view(s, d, _CAND), "accession", 100).select("accession"), "SELECT o_orderkey AS accession FROM orders ORDER BY 1 LIMIT 100")
_EV = "SELECT o_orderkey % 1000 AS accession, ' t' || (o_custkey % 50) || ' ' AS ticker, o_orderkey AS id FROM {orders}"
_OC = "SELECT c_custkey % 1000 AS accession, 'T' || (c_custkey % 50) AS ticker, c_acctbal AS car FROM {customer} WHERE c_custkey < 1000"
_add("outcomes_by_filing", lambda s, d: B.with_outcomes_by_filing(view(s, d, _EV), view(s, d, _OC)).select("id", F.round("car", 6).alias("car")), f"WITH {cte('e', _EV)}, {cte('o', _OC)} SELECT id, round(car, 6) AS car FROM e LEFT JOIN o ON o.accession = e.accession AND o.ticker = upper(trim(e.ticker))")
_add("price_context", lambda s, d: B.price_context(A.prices(s, d), A.market(s, d), A.prices(s, d).where("day is not null").select("ticker", F.col("day").alias("reaction_day"))), """WITH p AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, avg(value) AS price FROM events GROUP BY 1, 2), m AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS mp FROM events GROUP BY 1), b AS (SELECT p.*, mp, row_number() OVER w AS n, lag(price, 1) OVER w AS e, lag(price, 6) OVER w AS p6, lag(price, 21) OVER w AS p21, lag(mp, 1) OVER w AS me, lag(mp, 21) OVER w AS m21 FROM p JOIN m USING (day) WINDOW w AS (PARTITION BY ticker ORDER BY day))
SELECT ticker, day AS reaction_day, CASE WHEN n - 2 >= 20 THEN round(e / p6 - 1, 6) END AS ret_5d, CASE WHEN n - 2 >= 20 THEN round(e / p21 - 1, 6) END AS ret_20d, CASE WHEN n - 2 >= 20 THEN round(me / m21 - 1, 6) END AS market_ret_20d FROM b""")

_ARM = "[" + ", ".join(f"'{a}'" for a in B.ARMS) + "]"
_MATRIX = """SELECT event_id AS row_number, 'e' || CAST(floor(event_id / 16.0) AS BIGINT) AS event_id, CASE WHEN event_id % 101 = 1 THEN 'bad' ELSE CASE event_id % 4 WHEN 0 THEN 'E1_prior_visible' WHEN 1 THEN 'E1_prior_issuer_masked' WHEN 2 THEN 'E1_prior_context_minimal' ELSE 'E1_t1_evidence_visible_replay' END END AS treatment, CASE WHEN event_id % 103 = 1 THEN 'u' ELSE 'e1_prior_hierarchy' END AS upstream_model_family,
  'p' || CAST(floor(event_id / 4.0) AS BIGINT) % 2 AS profile, CASE WHEN event_id % 107 = 1 THEN ' ' ELSE 'retail' END AS profile_group, 'm' || CAST(floor(event_id / 8.0) AS BIGINT) % 2 AS model_family, '0' AS representation_seed, '1' AS decision_seed,
  CASE WHEN event_id % 109 = 1 THEN 'S001' WHEN event_id % 4 = 3 THEN CASE WHEN event_id % 113 = 3 THEN '[]' WHEN event_id % 127 = 3 THEN '["X999", "S001"]' ELSE '["S001", " S002"]' END WHEN event_id % 131 = 0 THEN '["S001"]' ELSE '[]' END AS evidence_used FROM {events}"""
_VIS = "SELECT 'e' || CAST(floor(event_id / 16.0) AS BIGINT) AS event_id FROM {events} WHERE event_id % 16 = 0 AND event_id % 17 <> 0"
_visible = lambda s, d: view(s, d, _VIS).withColumn("ids", F.array(F.lit("S001"), F.lit("S002")))
_MX = f"""{cte('mx', _MATRIX)}, {cte('vi', _VIS)}, a AS (SELECT mx.*, trim(profile_group) = '' AS blank, list_contains({_ARM}, treatment) AS known, treatment = '{B.ARMS[-1]}' AS replay, evidence_used <> 'S001' AS listed, vi.event_id IS NOT NULL AS shown FROM mx LEFT JOIN vi USING (event_id)), g AS (SELECT *, NOT blank AND known AS good FROM a),
fi AS (SELECT row_number, 'missing_required_value' AS code, 'profile_group' AS detail FROM g WHERE blank UNION ALL SELECT row_number, 'unknown_treatment', treatment FROM g WHERE NOT blank AND NOT known UNION ALL SELECT row_number, 'unexpected_upstream_model_family', 'u' FROM g WHERE good AND upstream_model_family = 'u' UNION ALL SELECT row_number, 'invalid_evidence_used', evidence_used FROM g WHERE good AND NOT listed
  UNION ALL SELECT row_number, 'prior_arm_has_citations', 'S001' FROM g WHERE good AND listed AND NOT replay AND evidence_used <> '[]' UNION ALL SELECT row_number, 'replay_arm_missing_citations', 'evidence_used is empty' FROM g WHERE good AND replay AND evidence_used = '[]' UNION ALL SELECT row_number, 'rendered_packet_error', event_id FROM g WHERE good AND listed AND replay AND evidence_used <> '[]' AND NOT shown
  UNION ALL SELECT row_number, 'citation_not_visible_in_replay_packet', 'X999' FROM g WHERE good AND listed AND replay AND shown AND contains(evidence_used, 'X999') UNION ALL SELECT 0, 'duplicate_decision_identity', count(*) || ' duplicate identities' FROM (SELECT 1 FROM mx GROUP BY event_id, treatment, profile, model_family HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 0, 'incomplete_matched_cells', count(*) || ' cells missing arms' FROM (SELECT 1 FROM mx GROUP BY event_id, model_family, profile HAVING list_sort(list(DISTINCT treatment)) <> list_sort({_ARM})) HAVING count(*) > 0 UNION ALL SELECT 0, 'unexpected_event_count', 'expected 7, found ' || count(DISTINCT event_id) FROM mx HAVING count(DISTINCT event_id) <> 7)"""
_add("matrix_findings", lambda s, d: B.matrix_findings(view(s, d, _MATRIX), _visible(s, d), events=7, profiles=2, models=["m0", "m1"]), f"WITH {_MX} SELECT * FROM fi UNION ALL SELECT 0, 'unexpected_profile_count', 'expected 2 profiles per event and model' FROM (SELECT 1 FROM mx GROUP BY event_id, model_family HAVING count(DISTINCT profile) <> 2) HAVING count(*) > 0")
_RULE = lambda when, field, code: f"SELECT row_number, '{field}' AS field, '{code}' AS code FROM b WHERE is_object AND {when}"
_TYPE = lambda f: f"json_type(j, '$.{f}')"
_NUM = lambda f: f"CASE WHEN {_TYPE(f)} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(j ->> '$.{f}' AS DOUBLE) END"
_INT = lambda f: f"CASE WHEN {_TYPE(f)} IN ('BIGINT', 'UBIGINT') THEN CAST(j ->> '$.{f}' AS BIGINT) END"
_NEEDED = ["event_id", "treatment", "profile", "profile_group", "model_family", "representation_seed", "decision_seed", "expected_return_5d", "confidence", "action", "action_strength", "key_reasons", "evidence_used", "uncertainty_notes"]
_STRINGS, _RANGES = ["event_id", "treatment", "profile", "profile_group", "model_family", "action"], {"expected_return_5d": 0.2, "confidence": 1.0, "action_strength": 1.0}
_FIND = " UNION ALL ".join([
    "SELECT row_number, 'row' AS field, 'invalid_type' AS code FROM b WHERE NOT is_object", *[_RULE(f"{_TYPE(f)} IS NULL", f, "missing_field") for f in _NEEDED],
    *[_RULE(f"{_TYPE(f)} IS NOT NULL AND {f} IS NULL", f, "invalid_type") for f in _STRINGS], *[_RULE(f"{_TYPE(f)} IS NOT NULL AND ({_INT(f)}) IS NULL", f, "invalid_type") for f in ("representation_seed", "decision_seed")], *[_RULE(f"{_TYPE(f)} IS NOT NULL AND ({_NUM(f)}) IS NULL", f, "invalid_type") for f in _RANGES],
    _RULE("treatment NOT IN ('T1_raw', 'B0', 'T2_shared', 'T3_profile')", "treatment", "invalid_value"), _RULE("model_family NOT IN ('m0', 'm1')", "model_family", "invalid_value"), _RULE("profile NOT IN (" + ", ".join(f"'{p}'" for p in I.PROFILES) + ")", "profile", "invalid_value"), _RULE("action NOT IN ('buy', 'hold', 'sell')", "action", "invalid_value"),
    _RULE("profile_group <> CASE profile " + " ".join(f"WHEN '{p}' THEN '{g}'" for p, (_, g) in I.PROFILES.items()) + " END", "profile_group", "profile_group_mismatch"), _RULE(f"{_TYPE('upstream_model_family')} IS NULL AND {_TYPE('request_metadata.passthrough_fields.upstream_model_family')} = 'VARCHAR'", "upstream_model_family", "missing_field"),
    _RULE(f"({_INT('representation_seed')}) > CASE WHEN split_part(treatment, '_', 1) IN ('T1', 'B0') THEN 0 ELSE 2 END", "representation_seed", "invalid_value"), _RULE(f"({_INT('decision_seed')}) NOT IN (1, 2)", "decision_seed", "invalid_value"),
    *[_RULE(f"(({_NUM(f)}) > {hi} OR ({_NUM(f)}) < {0.0 if f == 'confidence' else -hi})", f, "out_of_range") for f, hi in _RANGES.items()], _RULE(f"{_TYPE('key_reasons')} NOT IN ('ARRAY', 'NULL')", "key_reasons", "invalid_type"), _RULE("key_reasons IS NOT NULL AND len(key_reasons) < json_array_length(j, '$.key_reasons')", "key_reasons", "invalid_item"),
    _RULE("event_id IS NOT NULL AND len(evidence_used) > 0 AND NOT shown", "evidence_used", "missing_source_packet"), _RULE("shown AND list_contains(evidence_used, 'X002')", "evidence_used", "invalid_source_ids"),
])
_RECORD = f"""WITH {NORMAL}, {cte('vi', _VIS.replace("'e' ||", "'evt_' ||"))}, b AS (SELECT pf.*, pj.j, coalesce(vi.event_id IS NOT NULL, false) AS shown FROM pf JOIN pj ON pj.ordinal = pf.row_number LEFT JOIN vi ON vi.event_id = pf.event_id), fi AS ({_FIND})
SELECT field, code, count(*) AS n, min(row_number) AS first_row, max(row_number) AS last_row FROM fi GROUP BY 1, 2"""
_TREATS = ["T1_raw", "B0", "T2_shared", "T3_profile"]
_add("record_findings", lambda s, d: B.record_findings(records(s, d), view(s, d, _VIS.replace("'e' ||", "'evt_' ||")).withColumn("ids", F.array(*[F.lit(f"S00{i}") for i in range(7)], F.lit("X000"), F.lit("X001"))), _TREATS, ["m0", "m1"]).groupBy("field", "code").agg(F.count("*").alias("n"), F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row")), _RECORD)
_WALK = "SELECT conv_id * 100 + turn AS id, chr(123) || '\"event_id\": \"e\", \"pre\": ' || chr(123) || '\"ret_5d\": 1, \"ret_60d\": 2' || chr(125) || ', \"outcome_blind\": \"abnormal return\", \"ticker\": \"' || CASE WHEN turn % 2 = 0 THEN '' ELSE 'ABC' END || '\", \"u\": [' || chr(123) || '\"text\": \"' || CASE turn % 4 WHEN 0 THEN 'later filings and CAR_1_5' WHEN 1 THEN 'an Abnormal Return' ELSE 'plain' END || '\"' || chr(125) || ']' || CASE WHEN conv_id % 3 = 0 THEN ', \"hidden_valence\": \"x\"' ELSE '' END || chr(125) AS j FROM {conversations}"
_walk = lambda s, d: audit.json_fields(view(s, d, _WALK), "id", "j")
_OF = f"""{cte('w', _WALK)}, o AS (SELECT id, '$.pre.ret_60d' AS path, 'post_event_return_field' AS category, 3 AS severity FROM w UNION ALL SELECT id, '$.hidden_valence', 'hidden_outcome_field', 3 FROM w WHERE contains(j, 'hidden_valence') UNION ALL SELECT id, '$.u[0].text', 'hidden_outcome_text', 3 FROM w WHERE contains(j, 'CAR_1_5')
  UNION ALL SELECT id, '$.u[0].text', 'future_source_text', 2 FROM w WHERE contains(j, 'later filings') UNION ALL SELECT id, '$.u[0].text', 'realized_reaction_text', 3 FROM w WHERE contains(j, 'an Abnormal Return'))"""
_add("outcome_findings", lambda s, d: B.outcome_findings(_walk(s, d)).select("id", "path", "category", F.col("severity").cast("int").alias("severity")), f"WITH {_OF} SELECT id, path, category, severity FROM o")
_add("outcome_audit", lambda s, d: B.outcome_audit(_walk(s, d)), f"WITH {_OF} SELECT id, CASE max(severity) WHEN 3 THEN 'high' ELSE 'medium' END AS risk, count(*) AS finding_count, string_agg(DISTINCT category, ';' ORDER BY category) AS categories, array_to_string(list_sort(list(category || '@' || path))[1:8], ' || ') AS examples FROM o GROUP BY 1")
_add("identifier_findings", lambda s, d: B.identifier_findings(_walk(s, d)), f"WITH {cte('w', _WALK)} SELECT id, '$.ticker' AS path, 'direct_identifier_field' AS category, 'high' AS severity FROM w WHERE contains(j, 'ABC') UNION ALL SELECT id, '$.hidden_valence', 'post_event_field_present', 'high' FROM w WHERE contains(j, 'hidden_valence')")
_add("loose_action_codes", lambda s, d: A.table(s, d, "events").groupBy("event_type").agg(F.sum(E.loose_action_code(F.when(F.col("event_type") == "error", "SELL").when(F.col("event_type") == "view", "buy").otherwise(F.col("event_type")))).alias("total")), "SELECT event_type, CAST(sum(CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 1 ELSE 0 END) AS BIGINT) AS total FROM events GROUP BY 1")
_add("safe_ratios", lambda s, d: A.table(s, d, "customer").select("c_custkey", F.round(E.safe_ratio(F.col("c_acctbal"), F.when(F.col("c_custkey") % 3 == 0, 0.0).when(F.col("c_custkey") % 3 == 1, 4.0)), 6).alias("ratio")), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN round(c_acctbal / 4, 6) END AS ratio FROM customer")


def _retried(s, d):
    def call(row):
        if row["c_custkey"] % 5 == 0:
            raise ValueError
        if row["c_custkey"] % 7 == 0:
            raise TimeoutError
        return {"c_custkey": row["c_custkey"], "answer": f"a{row['c_custkey']}"}

    return B.retried(call, A.table(s, d, "customer").select("c_custkey"), "c_custkey bigint, answer string")


_add("retried_calls", _retried, "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'a' || c_custkey END AS answer, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 = 0 THEN 3 ELSE 1 END AS attempt, CASE WHEN c_custkey % 5 = 0 THEN 'ValueError' WHEN c_custkey % 7 = 0 THEN 'TimeoutError' END AS error FROM customer")
