import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.functions import expr as X
from tessella.functions import text as T
from tessella.operators import audit, cells, contrasts, inference, selection
from tessella.plans import briefs as brief_plans  # noqa: F401
from tessella.plans import registry
from tessella.sources import records

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([round(float(r[i]), 5) + 0.0 if isinstance(r[i], float) or type(r[i]).__name__ == "Decimal" else str(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", ["cell_metrics", "contrasts_long", "transition_summary", "event_outcomes", "bh_fdr", "time_balanced_pick", "leakage_scan", "unit_comparison"])
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, got.fetchall())


@pytest.mark.parametrize("name", ["abnormal_windows", "event_outcomes", "price_context"])
def test_prices_of_zero_give_what_sql_gives(spark, tmp_path, name):
    """a price of 0 made the first two fail and the third null where SQL has infinity or NaN."""
    con = duckdb.connect()
    con.execute(f"""copy (select d * 3 + u as event_id, timestamp '2024-01-01 09:00:00' + to_days(CAST(d AS INT)) as ts, u as user_id, 'view' as event_type, CASE WHEN (u = 1 and d in (3, 9, 10)) or (u = 2 and d = 25) or d = 2 THEN 0.0 ELSE 1.5 + (d * 7 + u * 3) % 11 END::DOUBLE as value, NULL::VARCHAR as props
        from range(30) a(d), range(3) b(u)) to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    df, got = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.ORACLE_SQL[name])
    names, want = [d[0] for d in got.description], got.fetchall()
    assert any(isinstance(v, float) and not math.isfinite(v) for r in want for v in r)
    assert _rows(df.columns, df.collect()) == _rows(names, want)


def test_market_means_do_not_hang_on_the_files(spark, tmp_path):
    """partial sums of the files were added up; here they lose what the sum by event_id keeps."""
    con = duckdb.connect(config={"threads": 1})
    (tmp_path / "events.parquet").mkdir()
    con.execute("""create table events as select (d * 3 + u)::BIGINT as event_id, timestamp '2024-01-01 09:00:00' + to_days(CAST(d AS INT)) as ts, u::BIGINT as user_id, 'view' as event_type, [1e16, -1e16, 1.5 + d][u + 1]::DOUBLE as value, NULL::VARCHAR as props from range(30) a(d), range(3) b(u) order by 1""")
    for i, keep in enumerate(("user_id <> 1", "user_id = 1")):
        con.execute(f"copy (select * from events where {keep} order by event_id) to '{tmp_path}/events.parquet/part-{i}.parquet'")
    df, got = registry.QUERIES["abnormal_windows"](spark, str(tmp_path)), con.execute(registry.ORACLE_SQL["abnormal_windows"])
    names, want = [d[0] for d in got.description], got.fetchall()
    assert _rows(df.columns, df.collect()) == _rows(names, want)


def test_price_context_of_no_ticker_and_no_day(spark, tmp_path):
    """prices without a ticker had null returns, those without a day gave rows that SQL has not."""
    con = duckdb.connect()
    con.execute("""create table events as select d * 3 + u as event_id, CASE WHEN d <> 12 OR u <> 1 THEN timestamp '2024-01-01 09:00:00' + to_days(CAST(d AS INT)) END as ts, CASE WHEN u <> 2 THEN u END as user_id, 'view' as event_type, (1.5 + (d * 7 + u * 3) % 11)::DOUBLE as value, NULL::VARCHAR as props from range(30) a(d), range(3) b(u)""")
    con.execute(f"copy events to '{tmp_path}/events.parquet'")
    df, got = registry.QUERIES["price_context"](spark, str(tmp_path)), con.execute(registry.ORACLE_SQL["price_context"])
    names, want = [d[0] for d in got.description], got.fetchall()
    assert any(r[0] is None and r[2] is not None for r in want) and len(want) == 89
    assert _rows(df.columns, df.collect()) == _rows(names, want)


def test_halves_that_a_double_misses_round_as_in_sql(spark):
    """9.63 / 6.40 - 1 is 0.5046875 in decimal digits and a little less as a double times a million."""
    con = duckdb.connect()
    cases = [0.5046875, 9.63 / 6.40 - 1, 3.17 / 6.40 - 1, 9.73 / 6.40 - 1, -0.0000005, 2.5, float("inf"), 0.0]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "x double").select(X.rounded(F.col("x"))).collect()]
    assert got == [con.execute("select round(?::double, 6)", [c]).fetchone()[0] for c in cases] and got[1] == 0.504687


def test_masking_findings_hold_every_match_of_all_rules(spark):
    texts = [
        "Shares of (NYSE: ABC) and Nasdaq: XYZ rose. Nasdaq: Company A did not.", "See 0001234567-24-000123, CIK 0000320193.", "Mail a.b@example.com or c@d.org, see https://x.io/a and www.y.net.",
        "Jane Q. Doe, founder, said John Roe left. Sam Poe, chief executive officer.", "On March 3, 2024 and\n  Apr. 5", "NEW YORK CITY, N.Y. and AUSTIN, Texas", "ARR and backlog after the merger or spin-off", None, "",
    ]
    got = audit.masking_findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.rule for r in got} == set(audit.MASKING) and len(audit.MASKING) == 12
    of = lambda rule: [r.match for r in got if r.rule == rule]
    assert of("exchange_ticker") == ["NYSE: ABC", "Nasdaq: XYZ"] and of("email") == ["a.b@example.com", "c@d.org"]
    assert of("url") == ["https://x.io/a", "www.y.net."] and of("exact_calendar_date") == ["March 3, 2024", "Apr. 5"]
    assert of("executive_name_after_said") == ["said John Roe"] and of("distinctive_metric") == ["ARR", "backlog"] and of("transaction_language") == ["merger", "spin-off"]
    assert [r.context for r in got if r.match == "Apr. 5"] == ["On March 3, 2024 and Apr. 5"]
    far = audit.masking_findings(spark.createDataFrame([(1, "x" * 100 + " merger " + "y" * 300)], "doc_id long, text string")).first()
    assert far.context == "x" * 79 + " merger " + "y" * 79


def test_json_fields_walk_every_depth(spark):
    deep = '{"a": {"b": {"c": [1, {"d": "merger"}, [true, null]]}}, "n": 1.50, "t": "{\\"k\\": 2}", "e": {}, "l": []}'
    rows = spark.createDataFrame([(1, deep), (2, "not json"), (3, None), (4, '[{"x": "y"}]'), (5, "7")], "id long, p string")
    assert [r[:] for r in audit.json_fields(rows, "id", "p").collect()] == [
        (1, "$.a.b.c[0]", "1"), (1, "$.a.b.c[1].d", "merger"), (1, "$.a.b.c[2][0]", "true"), (1, "$.a.b.c[2][1]", None), (1, "$.n", "1.50"), (1, "$.t", '{"k": 2}'), (4, "$[0].x", "y")]
    assert [r[:] for r in audit.json_masking_findings(rows, "id", "p").collect()] == [(1, "$.a.b.c[1].d", "transaction_language", "low", "merger", "merger")]


def test_mean_abs_difference_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 9):
        v = [rng.uniform(-1, 1) for _ in range(n)]
        got = spark.createDataFrame([(v,)], "v array<double>").select(X.mean_abs_difference(F.col("v"))).first()[0]
        pairs = [abs(a - b) for a, b in itertools.combinations(v, 2)]
        assert got is None if not pairs else abs(got - sum(pairs) / len(pairs)) < 1e-12


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], [])], "a array<string>, b array<string>")
    assert df.select(X.jaccard(F.col("a"), F.col("b"), 1.0), X.jaccard(F.col("a"), F.col("b"), None)).first()[:] == (1.0, None)


def test_numbers_from_text(spark):
    df = spark.createDataFrame([(x,) for x in ("1.5", "nan", "1d", " 2 ", "inf", "", None, "3.0")], "x string")
    assert [r[0] for r in df.select(X.to_double(F.col("x"))).collect()] == [1.5, None, None, 2.0, None, None, None, 3.0]
    assert [r[0] for r in df.select(X.to_long(F.col("x"))).collect()] == [None, None, None, 2, None, None, None, 3]


def test_sign_tests(spark):
    deltas = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.0)], "event_id string, delta double")
    assert inference.sign_test(deltas).first()["p_value"] == 0.5
    assert inference.sign_flip(deltas).first()[:] == (8, 0.5)


def test_matrix_rules(spark):
    rows = spark.createDataFrame([("e", "replay", ["S001", "X004"]), ("e", "replay", ["X999"]), ("e", "prior", ["S001"]), ("e", "prior", [])], "event_id string, treatment string, evidence_used array<string>")
    seen = spark.createDataFrame([("e", ["S001", "X004"])], "event_id string, visible_ids array<string>")
    found = audit.matrix_findings(rows, seen, ["prior"], "replay").select("code").collect()
    assert sorted(r[0] for r in found) == ["citation_in_prior_arm", "citation_not_visible"]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"event_id": "e1", "action": "buy"}\n\n{broken\n')
    rows, bad = records.read_jsonl(spark, str(tmp_path))
    assert [r.event_id for r in rows.collect()] == ["e1"] and bad.count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("Notably, sales rose 5% in S001. Next one!", "see S1 and X12 and S001")], "a string, b string")
    r = df.select(T.safe_edit(F.col("a")), T.repaired_ids(F.col("b")), F.size(T.packed_paragraphs(F.col("a"), 10)), X.source_ids(F.col("b"))).first()
    assert r[0].startswith("Sales rose") and r[1] == "see S001 and X012 and S001" and r[2] == 2 and r[3] == ["S001"]


def test_reasons_and_targets(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert df.select(selection.eligibility_reasons({"a": F.col("a") > 1, "b": F.col("b") > 1})).first()[0] == "a;b"
    assert selection.balanced_targets({"x": 5, "y": 3}, 4) == {"x": 3, "y": 3}


def test_contrasts_are_antisymmetric_in_their_deltas(spark):
    cells = registry.QUERIES["cell_metrics"](spark, SF)
    long = contrasts.contrasts_long(cells).where("contrast = 'B0_minus_T1'")
    assert long.where("abs(delta - (comparison - baseline)) > 1e-6").count() == 0 and long.count() > 0


def test_pair_distances_equal_all_pairs(spark):
    """F8: the mean came from a join of all pairs of a label."""
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], [rng.gauss(0, 1) for _ in range(4)]) for i in range(20)] + [(30, "a", [0.0] * 4), (31, "a", [0.0] * 4), (32, "b", None), (33, "b", [1.0, None, 0.0, 0.0]), (34, "b", [1.0, 2.0]), (35, "c", [1.0]), (36, None, [1.0]), (37, None, [1.0]), (38, "n", [float("nan")]), (39, "n", [1.0]), (40, "z", [0.0]), (41, "z", [float("inf")])]
    e = spark.createDataFrame(rows, "vec_id long, label string, v array<double>")
    got = {r.label: r[1:] for r in cells.pair_distances(e, "label", "v").collect()}
    x = e.alias("a").join(e.alias("b"), F.expr("a.label = b.label and a.vec_id < b.vec_id")).select("a.label", X.cosine_distance(F.col("a.v"), F.col("b.v")).alias("d"))
    want = {r.label: r[1:] for r in x.groupBy("label").agg(F.count("*"), F.round(F.avg("d"), 6), F.round(F.avg(F.col("d") / 2), 6)).collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items())) and set(got) == set("abnz")
    assert "NestedLoop" not in (plan := cells.pair_distances(e, "label", "v")._jdf.queryExecution().optimizedPlan().toString()) and plan.count("vec_id < ") == 0


def test_replicates_share_draws_of_any_size(spark):
    """draws were a joined row for each replicate, slot and test."""
    import hashlib

    rows = [(t, f"e{i:03d}", float(i * i % 17)) for t, n in (("p", 5), ("q", 40)) for i in range(n)]
    got = {(r.t, r.rep): r.mu for r in inference.replicate_means(spark.createDataFrame(rows, "t string, event_id string, delta double"), ["t"], "delta", 100).collect()}
    for t, n in (("p", 5), ("q", 40)):
        v = [r[2] for r in rows if r[0] == t]
        for rep in (0, 57, 99):
            assert got[t, rep] == pytest.approx(sum(v[int(hashlib.md5(f"{rep}:{k}".encode()).hexdigest()[:12], 16) % n] for k in range(n)) / n)
    assert len(got) == 200


def test_digests_of_draws_are_md5():
    """the published numbers of replicates need many digests, so they are computed for whole arrays."""
    import hashlib

    for rep, n in ((0, 1), (7, 11), (499, 2345), (19999, 101203)):
        got = inference.md5_heads(rep, n)
        assert len(got) == n
        for k in {*range(min(n, 130)), *range(0, n, 37), *range(max(0, n - 1300), n)}:
            assert got[k] == int(hashlib.md5(f"{rep}:{k}".encode()).hexdigest()[:12], 16)


def test_action_contrasts_test_every_metric_with_all_replicates(spark, duck):
    """2 of 9 metrics were tested, with 500 of 5,000 replicates."""
    from tessella.operators import experiment
    from tessella.plans import experiment as plans  # noqa: F401

    df = registry.QUERIES["action_contrasts"](spark, SF)
    rows = df.collect()
    assert {r.metric for r in rows} == set(experiment.TESTED_METRICS) and len(experiment.TESTED_METRICS) == 9
    steps = {round(r.p_value * 2500, 6) for r in rows}
    assert all(s == int(s) for s in steps) and any(s % 10 for s in steps)
    got = duck.execute(registry.ORACLE_SQL["action_contrasts"])
    names = [d[0] for d in got.description]
    assert _rows(df.columns, rows) == _rows(names, got.fetchall())


def test_event_bootstrap_makes_all_replicates(spark, duck):
    """200 of 20,000 replicates were made."""
    df = registry.QUERIES["event_bootstrap"](spark, SF)
    rows = df.collect()
    tail = rows[0].p_unclipped * 10000
    assert abs(tail - round(tail)) < 1e-6 and round(tail) % 100
    got = duck.execute(registry.ORACLE_SQL["event_bootstrap"])
    names = [d[0] for d in got.description]
    assert _rows(df.columns, rows) == _rows(names, got.fetchall())
