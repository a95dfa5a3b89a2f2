import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import manifests, packets
from tessella.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["fiscal_period", "chosen_facts", "period_of_facts", "citation_repair", "masked_packets", "entity_visible", "manifest_apply", "manifest_adjudication", "python_literal_repair"]


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in "orders lineitem events customer conversations labels".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=str)


def values(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_masking_takes_the_longest_name_first(spark):
    got = values(spark, packets.company_aliases(F.lit("Acme Widgets, Inc./DE"), F.lit("acw")))
    assert got == ["Acme Widgets, Inc./DE", "Acme Widgets Inc DE", "Acme Widgets, Inc.", "Acme Widgets DE", "Acme Widgets", "ACW"]
    text = "ACME  widgets said President Mary Ann Lee; Jan. 05, 2024 and 2024-01-05, ACWX is another.\nCost $5"
    masked = packets.masked_text(F.lit(text), F.lit("Acme Widgets, Inc./DE"), F.lit("acw"), F.array(F.lit(dt.date(2024, 1, 5))), F.lit(None).cast("string"), F.lit("Co $1"))
    assert values(spark, masked) == "Co $1 said President; masked_timestamp and masked_timestamp, ACWX is another. Cost $5"
    assert values(spark, packets.masked_text(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<date>"), F.lit(""), F.lit("M"))) is None


def test_unmasking_skips_blank_values(spark):
    text = F.lit("Company A (NASDAQ : Company A) at masked_timestamp")
    some = [F.lit(x) for x in ("Company A", "Acme $1", "ACM", " ")]
    assert values(spark, packets.unmasked_text(text, *some)) == "Acme $1 (NASDAQ:ACM) at masked_timestamp"
    assert values(spark, packets.unmasked_text(text, *[F.lit(None).cast("string")] * 4)) == "Company A (NASDAQ : Company A) at masked_timestamp"


def test_fiscal_period_forms(spark):
    for text, want in {"Q4 quarter results for 2023": "FY2023 Q4", "2021 third quarter": "FY2021 Q3", "quarter ended Dec 31, 2020": "FY2020 Q4", "three months ended April 30, 2020; fiscal year 2020": "FY2020", "nothing": None, "x" * 3000 + " fiscal year 2020": None}.items():
        assert values(spark, packets.fiscal_period(F.lit(text))) == want


def test_citation_repair_at_the_edges(spark):
    valid = F.array(*map(F.lit, ("S001", "X012", "CTX1")))
    for text, want in {"": ("", [], [], []), "S1": ("S001", [("S1", "S001")], [], []), "S12 S1 ": ("S12 S001 ", [("S1", "S001")], [], ["S12"]), "(S12) CTX2 S0001.": ("(X012) CTX2 S001.", [("S12", "X012"), ("S0001", "S001")], ["CTX2"], []), "S000 XS1,": ("S000 XS1,", [], ["S000"], [])}.items():
        r = values(spark, packets.repaired_citations(F.lit(text), valid))
        assert (r["text"], [tuple(x) for x in r["repairs"]], r["unresolved"], r["ignored"]) == want


def test_leaf_blocks(spark):
    page = "<title>t</title><body><h2>Our Results</h2><div><p>One  <b>two</b></p><p>ONE two</p></div><script>p</script><ul><li>Item &amp;lt;</ul><div>tail<br>more</div><p>Note:</p><p>end</p>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>QUARTER IN BRIEF</p><p>body</p><p>" + "LONG " * 40 + "</p>")], "page_id int, html string")
    got = packets.leaf_blocks(rows).orderBy("page_id", "at").collect()
    assert [(b.heading, b.text) for b in got if b.page_id == 1] == [("Our Results", "One two"), ("Our Results", "Item <"), ("Our Results", "tail more"), ("Note:", "end")]
    assert [(b.page_id, b.heading) for b in got if b.page_id > 1] == [(4, "QUARTER IN BRIEF")] * 2


def test_manifest_reader_is_strict(spark, tmp_path):
    row = {"event_id": "e", "evidence_id": "1", "category": "c", "value": 1.5, "source_ids": ["S001"], "support_label": "direct", "original_claim": "a", "approved": True, "proposed_t5_claim": "b"}
    path = tmp_path / "m.jsonl"

    def written(*lines):
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    good = json.dumps(row)
    got = manifests.read_manifest(spark, written(good, json.dumps({**row, "evidence_id": "2"}).replace("true", "True")), repair=True).collect()
    assert len(got) == 2 and all(r.approved for r in got) and got[0].value == "1.5"
    bad = {"blank": "  ", "not a JSON object": "[1]", "missing fields: value": json.dumps({k: v for k, v in row.items() if k != "value"}), "approved must be boolean": json.dumps({**row, "approved": "yes"}), "invalid event_id": json.dumps({**row, "event_id": ""}), "must be a string": json.dumps({**row, "proposed_t5_claim": 3})}
    for message, line in bad.items():
        with pytest.raises(ValueError, match=message):
            manifests.read_manifest(spark, written(good, line))
    with pytest.raises(ValueError, match="repeated"):
        manifests.read_manifest(spark, written(good, good))
    path.write_text("")
    with pytest.raises(ValueError, match="empty"):
        manifests.read_manifest(spark, str(path))


def test_undecided_keys(spark):
    a = spark.createDataFrame([("e", "1"), ("e", "2")], manifests.KEY)
    b = spark.createDataFrame([("e", "2"), ("e", "3")], manifests.KEY)
    assert {tuple(r) for r in manifests.undecided(a, b).collect()} == {("e", "1", "missing"), ("e", "3", "extra")}
