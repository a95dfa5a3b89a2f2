import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import briefs, experiment
from tessella.plans import briefs as brief_plans  # noqa: F401
from tessella.plans import experiment as experiment_plans  # noqa: F401
from tessella.plans import intake as intake_plans  # noqa: F401
from tessella.plans import registry
from tessella.sources import intake

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(float(r[i]), 5) + 0.0 if isinstance(r[i], float) or type(r[i]).__name__ == "Decimal" else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", ["normalised_decisions", "quarantined_decisions", "sniffed_records", "output_records", "full_contrasts_wide", "full_action_cells", "ledger_rows", "matrix_findings", "record_findings", "stratified_candidates", "screening_rows"])
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns) and _rows(df.columns, df.collect()) == _rows(names, got.fetchall())


def test_files_of_each_form_are_read(spark, tmp_path):
    files = {"a.jsonl": '{"x": 1}\n\nnot json\n{"x": 2}\n', "b.json": '[{"x": 3}, 4]', "c.json": '{"x": 5}', "d.json": "  \n", "e.json": '"text"', "f.json": '{"x": 6}\n{"x": 7}', "g/h.json": "[broken"}
    (tmp_path / "g").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    rows = {(r.path.split("/")[-1], r.ordinal): (r.format, r.error, r.value) for r in intake.sniffed(intake.read_whole(spark, str(tmp_path))).collect()}
    assert rows[("a.jsonl", 1)][:2] == ("jsonl", None) and rows[("a.jsonl", 3)][:2] == ("jsonl", "invalid_jsonl_line") and ("a.jsonl", 2) not in rows
    assert json.loads(rows[("b.json", 1)][2]) == {"x": 3} and rows[("c.json", 1)][:2] == ("json_object", None)
    assert not any(k[0] == "d.json" for k in rows) and rows[("e.json", 1)][1] == "unsupported_json" and rows[("h.json", 1)][1] == "invalid_json"
    assert [rows[("f.json", i)][0] for i in (1, 2)] == ["jsonl", "jsonl"]


def _record(**more):
    return json.dumps({"event_id": " e1 ", "treatment": "T2_x", "profile": "retail_day_trader", "model_family": "m", "representation_seed": "1", "decision_seed": 2, "expected_return_5d": "0.01", "confidence": 0.5, "action": " BUY", "action_strength": 1, "key_reasons": ["a ", "", 3, "b"], "evidence_used": ["S001"]} | more)


def test_normaliser_coerces_and_quarantines(spark):
    cases = [_record(), _record(expected_return_5d=True), _record(representation_seed=1.5), _record(action="short"), _record(profile="who"), _record(profile="who", profile_group="retail"), "[1]", "oops", _record(key_reasons="a"), _record(treatment="T1"), _record(request_metadata={"passthrough_fields": {"upstream_model_family": "u"}}), None]
    got = {r.row_number: r for r in intake.normalised(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "ordinal int, value string")).collect()}
    r = got[0]
    assert (r.event_id, r.action, r.action_code, r.profile_canonical, r.profile_group, r.representation_seed, r.expected_return_5d, r.rationale_text, r.treatment_family, r.upstream_model_family, r.code) == ("e1", "buy", 1, "day_trader", "retail", 1, 0.01, "a b", "T2", "legacy_unspecified", None)
    assert [(got[i].code, got[i].fields) for i in (1, 2, 8)] == [("missing_or_unparseable_fields", f) for f in ("expected_return_5d", "representation_seed", "key_reasons")]
    assert [got[i].code for i in (3, 4, 5, 6, 7, 11)] == ["invalid_action", "unknown_profile_group", None, "invalid_row_type", "invalid_row_type", "invalid_row_type"]
    assert got[9].upstream_model_family == "none" and got[10].upstream_model_family == "u"


def test_outcomes_warn_about_headers_and_repeats(spark):
    rows = spark.createDataFrame([(2, "e1", "0.1"), (3, "e1", "0.2"), (4, " ", "0.3"), (5, "e2", "nan")], "row_number long, event_id string, ` hidden_CAR_1_5 ` string")
    kept, warnings = intake.hidden_outcomes(rows)
    assert sorted((r.event_id, r.CAR_1_5) for r in kept.collect()) == [("e1", 0.1), ("e2", None)]
    assert sorted(r.code for r in warnings.collect()) == ["duplicate_event_id", "missing_event_id", "missing_hidden_valence_column"]
    with pytest.raises(ValueError):
        intake.hidden_outcomes(rows.drop("event_id"))


def test_recovered_objects(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', "```\n[1]\n```", 'see {"a": 3} there', "{broken", None, "", 'text ``` {"a": 4} ``` {"a": 5}']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.try_variant_get(intake.recovered_object(F.col("t")), "$.a", "int").alias("a")).orderBy("i").collect()
    assert [r.a for r in got] == [1, 2, None, 3, None, None, None, 4]


def _decision(i, event, family, profile, er, group="retail", **more):
    base = {"row_number": i, "event_id": event, "treatment": family, "treatment_family": family, "profile_canonical": profile, "profile_group": group, "model_family": "m", "upstream_model_family": "none" if family in ("T1", "B0") else "u", "representation_seed": 0, "decision_seed": 1, "expected_return_5d": er, "confidence": 0.5, "action": "buy", "action_code": 1, "action_strength": 0.1, "evidence_used": [], "categories": None, "coverage": None, "car": None}
    return base | more


KIND = "row_number long, event_id string, treatment string, treatment_family string, profile_canonical string, profile_group string, model_family string, upstream_model_family string, representation_seed long, decision_seed long, expected_return_5d double, confidence double, action string, action_code int, action_strength double, evidence_used array<string>, categories array<string>, coverage double, car double"


def test_traps_of_cells_and_contrasts(spark):
    rows = [_decision(1, "e", "T1", "day_trader", 0.1), _decision(2, "e", "T1", "swing_trader", 0.2), _decision(3, "e", "T2", "day_trader", 0.1), _decision(4, "e", "T2", "swing_trader", 0.1), _decision(5, "e", "T3", "day_trader", 0.0), _decision(6, "e", "T3", "swing_trader", 0.0), _decision(7, "e", "T2", "unprofiled_baseline", 0.4, "unprofiled")]
    rows += [_decision(8, "f", "T2", "day_trader", 0.1), _decision(9, "f", "T2", "day_trader", 0.3)]  # a profile twice: no cell
    rows += [_decision(10, "e", "T2", "day_trader", 0.5, representation_seed=1), _decision(11, "e", "T2", "swing_trader", 0.7, representation_seed=1)]
    cells, warnings = experiment.cells(spark.createDataFrame([tuple(r.values()) for r in rows], KIND))
    cells = cells.cache()
    got = {(r.event_id, r.treatment, r.representation_seed, r.investor_group): r for r in cells.collect()}
    assert [r.profiles for r in warnings.collect()] == ["day_trader"] and not any(k[0] == "f" for k in got)
    # all_profiles holds rows without a known profile too; empty evidence sets overlap fully
    assert got["e", "T2", 0, "all_profiles"].profile_count == 3 and got["e", "T2", 0, "all_profiles"].source_overlap == 1.0 and got["e", "T2", 0, "unprofiled"].is_complete_group
    assert got["e", "T1", 0, "retail"].missing_profiles == '["long_term_retail"]' and got["e", "T1", 0, "retail"].category_overlap is None
    long, more = experiment.contrasts(cells)
    x = {(r.contrast, r.representation_seed, r.metric): r for r in long.where("investor_group = 'retail'").collect()}
    # the T1 row is repeated for both seeds of T2; T3 without spread is no denominator
    assert x["T2_minus_T1", 0, "belief_mad"].delta == pytest.approx(-0.1) and x["T2_minus_T1", 1, "belief_mad"].delta == pytest.approx(0.1)
    assert x["T3_minus_T2", 0, "belief_mad"].normalized_index is None and not x["T3_minus_T2", 0, "belief_mad"].is_stable and more.count() == 0
    twice = cells.unionByName(cells.where("treatment_family = 'T1'"))
    assert experiment.contrasts(twice)[0].where("contrast like '%T1'").count() == 0 and experiment.contrasts(twice)[1].count() > 0


def test_action_cells_leave_unprofiled_rows_out(spark):
    rows = [_decision(1, "e", "T1", "day_trader", 0.1), _decision(2, "e", "T1", "unprofiled_baseline", 0.2, "unprofiled")]
    got = experiment.action_cells(spark.createDataFrame([tuple(r.values()) for r in rows], KIND)).collect()
    assert sorted((r.investor_group, r.profile_count, r.same_share) for r in got) == [("all_profiles", 1, None), ("retail", 1, None)]


def test_frozen_events_must_be_complete(spark):
    rows = spark.createDataFrame([tuple(_decision(1, "e", "T1", "day_trader", 0.1).values())], KIND)
    with pytest.raises(ValueError, match="no complete pair"):
        experiment.frozen_deltas(rows, rows, "T1", "T2", F.col("expected_return_5d"))


def _matrix(spark, **change):
    rows = [{"row_number": i + 2, "event_id": "e1", "treatment": a, "upstream_model_family": "e1_prior_hierarchy", "profile": "p", "profile_group": "retail", "model_family": "m", "representation_seed": "0", "decision_seed": "1", "evidence_used": '["S001", "X004"]' if a == briefs.ARMS[-1] else "[]"} for i, a in enumerate(briefs.ARMS)]
    for i, more in change.get("rows", {}).items():
        rows[i] |= more
    rows += change.get("extra", [])
    visible = spark.createDataFrame([("e1", ["S001", "X004"])], "event_id string, ids array<string>")
    found = briefs.matrix_findings(spark.createDataFrame([tuple(r.values()) for r in rows], "row_number long, event_id string, treatment string, upstream_model_family string, profile string, profile_group string, model_family string, representation_seed string, decision_seed string, evidence_used string"), visible, **change.get("expect", {}))
    return sorted((r.row_number, r.code) for r in found.collect())


def test_matrix_of_prior_arms(spark):
    assert _matrix(spark, expect={"events": 1, "profiles": 1, "total": 4, "models": ["m"]}) == []
    assert _matrix(spark, rows={3: {"evidence_used": '["X999"]'}}) == [(5, "citation_not_visible_in_replay_packet")]
    assert _matrix(spark, rows={0: {"evidence_used": '["S001"]'}}) == [(2, "prior_arm_has_citations")]
    assert _matrix(spark, rows={3: {"evidence_used": "[]"}}) == [(5, "replay_arm_missing_citations")]
    assert _matrix(spark, rows={3: {"evidence_used": '["S001", ""]'}}) == [(5, "invalid_evidence_used")]
    assert _matrix(spark, rows={1: {"profile_group": " "}}) == [(3, "missing_required_value")]
    assert _matrix(spark, rows={1: {"treatment": "E1_prior_visible"}}) == [(0, "duplicate_decision_identity"), (0, "incomplete_matched_cells")]
    assert _matrix(spark, expect={"events": 2, "total": 3, "models": ["m", "n"]}) == [(0, "unexpected_event_count"), (0, "unexpected_model_families"), (0, "unexpected_row_count")]


def test_source_units_look_back_at_what_was_kept(spark):
    long = "A sentence about revenue of the year, with more words than a block needs to stay. " * 3
    inner = "A sentence about revenue of the year, with more words"
    blocks = [("e", 1, "", long), ("e", 2, "", inner), ("e", 3, "", "Webcast replay details are on the page of the company."), ("e", 4, "Outlook", "We will see 5 percent more of everything in this place."), ("e", 5, "", long.upper())]
    fillers = [("f", k, "", f"Block number {k} holds its own words and a figure of {k * 7}.") for k in range(1, 15)]
    got = briefs.source_units(spark.createDataFrame([*blocks, ("f", 0, "", long), *fillers, ("f", 20, "", inner)], "event_id string, ordinal int, heading string, text string")).collect()
    e = sorted((r.source_id, r.section) for r in got if r.event_id == "e")
    assert e == [("S001", "revenue"), ("S002", "guidance")]
    assert sum(r.text == inner for r in got if r.event_id == "f") == 1  # the long unit is more than 12 units back


def test_letters_and_ids(spark):
    got = spark.createDataFrame([(0,), (1,), (26,), (27,), (702,), (703,)], "n long").select(briefs.letters(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["", "A", "Z", "AA", "ZZ", "AAA"]
    rows = spark.createDataFrame([(1, None), (2, "evt_0001"), (3, None), (4, "evt_0003"), (5, None)], "k int, event_id string")
    assert sorted((r.k, r.event_id) for r in briefs.assigned_ids(rows.select("event_id", "k"), "k").collect()) == [(1, "evt_0002"), (2, "evt_0001"), (3, "evt_0004"), (4, "evt_0003"), (5, "evt_0005")]


def test_price_panels(spark):
    rows = spark.createDataFrame([("SPY", "2024-01-02", "5", "4"), ("a", "2024-01-02", "1.5", "1"), ("b", "bad", "2", "2"), (None, "2024-01-03", "1", "1")], "Ticker string, DATE string, close string, Adj_Close string")
    assert sorted((r.ticker, r.price) for r in intake.price_panel(rows).collect()) == [("A", 1.0), ("SPY", 4.0)]
    assert sorted(r.price for r in intake.price_panel(rows.drop("Adj_Close")).collect()) == [1.5, 5.0]
    for bad in (rows.drop("Adj_Close"), rows.unionByName(rows), rows.where("ticker = 'a'")):
        with pytest.raises(ValueError):
            intake.price_panel(bad, strict=True)


def test_markdown(spark):
    rows = spark.createDataFrame([("a|b", 1.23456), ("c", None)], "x string, y double")
    assert experiment.markdown(rows, ["x", "y"]) == "| x | y |\n| --- | --- |\n| a\\|b | 1.2346 |\n| c |  |\n"


@pytest.mark.parametrize("name", ["full_cells", "full_contrasts"])
def test_cells_read_their_records_once(spark, name):
    """decisions, their own categories and looked-up ones were three readings, each parsed again."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 1


@pytest.mark.parametrize("name", ["frozen_deltas", "layer_correlations", "run_summary"])
def test_queries_with_several_uses_keep_their_records(spark, duck, name):
    """every use parsed all records again."""
    df = registry.QUERIES[name](spark, SF)
    assert "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
    got = duck.execute(registry.ORACLE_SQL[name])
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in got.description], got.fetchall())
    spark.catalog.clearCache()
