"""Records from JSON and CSV text of unknown form: sniffing, normalising, quarantine, indexes and prices.

Every function works on tables of text columns, so the same plan serves files
(``read_whole``) and tables that already hold the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import expr as X

#: Profiles, their canonical names and groups.
PROFILES = {
    "day_trader": ("day_trader", "retail"),
    "retail_day_trader": ("day_trader", "retail"),
    "swing_trader": ("swing_trader", "retail"),
    "retail_swing_trader": ("swing_trader", "retail"),
    "long_term_retail": ("long_term_retail", "retail"),
    "retail_long_term_fundamental": ("long_term_retail", "retail"),
    "event_driven_hedge_fund": ("event_driven_hedge_fund", "institutional"),
    "institutional_event_driven_hedge_fund": ("event_driven_hedge_fund", "institutional"),
    "prop_trading": ("prop_trading", "institutional"),
    "institutional_prop_trader": ("prop_trading", "institutional"),
    "institutional_prop_trading": ("prop_trading", "institutional"),
    "investment_advisor": ("investment_advisor", "institutional"),
    "institutional_investment_advisor": ("investment_advisor", "institutional"),
    "unprofiled_baseline": ("unprofiled_baseline", "unprofiled"),
}
#: Upstream family of treatments that have no generator, and of all others.
UPSTREAM = {"T1": "none", "B0": "deterministic_canonical_evidence", "T5": "deterministic_linguistic_deframing", "T6": "deterministic_evidence_order_randomization"}
LEGACY_UPSTREAM = "legacy_unspecified"
#: Fields of a request's key, without and with the upstream family.
KEY_FIELDS = ("event_id", "treatment", "profile", "profile_group", "model_family", "representation_seed", "decision_seed")
LONG_KEY_FIELDS = ("event_id", "treatment", "upstream_model_family", "profile", "profile_group", "model_family", "representation_seed", "decision_seed")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a folder, ordered by path where the order matters downstream."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _pair(text: Column) -> Column:
    """The items of [text, "end"]: two, the second "end", where the text is one JSON value with nothing after it."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(', "end"]'))), "$", "array<variant>")


def _first_of(pair: Column) -> Column:
    whole = (F.size(pair) == 2) & (F.try_variant_get(F.try_element_at(pair, F.lit(2)), "$", "string") == "end")
    return F.when(whole, F.try_element_at(pair, F.lit(1)))


def parsed(text: Column) -> Column:
    """One JSON value as a variant; null for anything else, also where more follows the value, which the parser would leave unread."""
    return _first_of(_pair(text))


def sniffed(files: DataFrame) -> DataFrame:
    """(path, ordinal, value, format, error) of files(path, content).

    Empty content gives no rows; content that begins with [ is a JSON array,
    whose items are the records; a .jsonl file, or content that is no JSON
    value, is read line by line, where blank lines are skipped and bad lines
    are errors; a JSON object is one record; any other value is an error.
    """
    text = F.regexp_replace("content", r"^\s+", "")
    whole = parsed(F.col("content"))
    kind = F.schema_of_variant(whole)
    array_ = text.startswith("[")
    lines = F.lower("path").endswith(".jsonl") | whole.isNull()
    form = F.when(text == "", "empty").when(array_, "json_array").when(lines, "jsonl").when(kind.startswith("OBJECT"), "json_object").otherwise("scalar")
    f = files.select("path", "content", whole.alias("whole"), form.alias("format")).where("format <> 'empty'")
    items = f.where("format = 'json_array'").select("path", "format", F.posexplode(F.when(F.col("whole").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.try_variant_get("whole", "$", "array<variant>"))).alias("at", "item"))
    items = items.select("path", (F.col("at") + 1).cast("long").alias("ordinal"), F.to_json("item").alias("value"), "format", F.when(F.col("item").isNull(), "invalid_json").alias("error"))
    rows = f.where("format = 'jsonl'").select("path", "format", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("at", "line"))
    rows = rows.select("path", (F.col("at") + 1).cast("long").alias("ordinal"), F.regexp_replace("line", r"^\s+|\s+$", "").alias("value"), "format").where("value <> ''")
    rows = rows.withColumn("error", F.when(parsed(F.col("value")).isNull(), "invalid_jsonl_line"))
    one = f.where("format in ('json_object', 'scalar')").select("path", F.lit(1).cast("long").alias("ordinal"), F.col("content").alias("value"), "format", F.when(F.col("format") == "scalar", "unsupported_json").alias("error"))
    return items.unionByName(rows).unionByName(one)


# -- values of one JSON field ---------------------------------------------------------------------


def _field(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _text(kind: Column, text: Column) -> Column:
    return F.when(kind == "STRING", X.blank_to_null(text))


def _numeric(kind: Column, text: Column) -> Column:
    return F.when((kind == "STRING") | kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), text)


def _whole(kind: Column, text: Column) -> Column:
    text = F.trim(_numeric(kind, text))
    return F.when((kind == "STRING") & ~text.rlike(r"^[+-]?\d+$"), F.lit(None).cast("bigint")).otherwise(X.to_long(text))


def json_text(value: Column) -> Column:
    """A string that is not blank, without outer white space; anything else: null."""
    return _text(_kind(value), _string(value))


def json_double(value: Column) -> Column:
    return X.to_double(_numeric(_kind(value), _string(value)))


def json_long(value: Column) -> Column:
    """Whole numbers; text must be digits only, numbers may end in .0."""
    return _whole(_kind(value), _string(value))


def json_texts(value: Column) -> Column:
    """The strings of a list that are not blank; null where the value is no list."""
    return F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), json_text), lambda x: x.isNotNull())


def _lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def normalised(records: DataFrame, value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """All fields of a decision for each JSON record, with ``code`` and ``fields`` of what is wrong; null code: usable.

    A row needs 12 fields that parse, a known action and a profile group,
    given or implied by the profile. The first failing check names the code.
    """

    kinds = {n: _text for n in ("event_id", "treatment", "profile", "profile_group", "model_family", "action", "upstream_model_family", "upstream_requested")}
    kinds |= {n: _whole for n in ("representation_seed", "decision_seed")} | {n: lambda k, t: X.to_double(_numeric(k, t)) for n in ("expected_return_5d", "confidence", "action_strength")}
    lists = ("key_reasons", "evidence_used", "uncertainty_notes", "evidence_categories")
    paths = {n: n for n in (*kinds, *lists)} | {"upstream_requested": "request_metadata.passthrough_fields.upstream_model_family"}
    at = lambda name: F.col(f"v.{name}")

    need = ("event_id", "treatment", "profile", "model_family", "representation_seed", "decision_seed", "expected_return_5d", "confidence", "action", "action_strength", "key_reasons", "evidence_used")

    def judged(f: Column) -> Column:
        family, action = X.family_of(f["treatment"]), F.lower(f["action"])
        group = F.coalesce(f["profile_group"], _lookup(f["profile"], {p: g for p, (_, g) in PROFILES.items()}))
        missing = F.array_join(F.filter(F.array(*[F.when(f[n].isNull(), n) for n in need]), lambda x: x.isNotNull()), ",")
        code = (
            F.when(~f["is_object"], "invalid_row_type")
            .when(missing != "", "missing_or_unparseable_fields")
            .when(X.action_code(action).isNull(), "invalid_action")
            .when(group.isNull(), "unknown_profile_group")
        )
        canonical = _lookup(f["profile"], {p: c for p, (c, _) in PROFILES.items()}, f["profile"])
        upstream = F.coalesce(f["upstream_model_family"], f["upstream_requested"], _lookup(family, UPSTREAM), F.lit(LEGACY_UPSTREAM))
        same = lambda *names: [f[n].alias(n) for n in names]
        return F.struct(
            *same("event_id", "treatment"), family.alias("treatment_family"), *same("profile"), canonical.alias("profile_canonical"), group.alias("profile_group"), *same("model_family"), upstream.alias("upstream_model_family"),
            *same("representation_seed", "decision_seed", "expected_return_5d", "confidence"), action.alias("action"), X.action_code(action).alias("action_code"), *same("action_strength", "key_reasons"),
            F.array_join(f["key_reasons"], " ").alias("rationale_text"), *same("evidence_used"), F.coalesce(f["uncertainty_notes"], F.array().cast("array<string>")).alias("uncertainty_notes"),
            f["evidence_categories"].alias("evidence_categories_direct"), code.alias("code"), F.when(f["is_object"] & (missing != ""), missing).otherwise("").alias("fields"),
        )

    # every step is bound once: an optimizer that merges them would parse the text again for each field and filter
    rows = records.select(F.col(ordinal).alias("row_number"), F.col(value).alias("value"))
    rows = X.bound(rows, ["row_number", "value"], _pair(F.col("value")), "pair")
    # what parses and begins with a brace is an object
    rows = X.bound(rows, ["row_number"], F.struct(_first_of(F.col("pair")).alias("r"), F.ltrim("value", F.lit(" \t\r\n")).startswith("{").alias("brace")), "p")
    rows = X.bound(rows, ["row_number"], F.struct((F.col("p.r").isNotNull() & F.coalesce("p.brace", F.lit(False))).alias("is_object"), *[_field(F.col("p.r"), path).alias(n) for n, path in paths.items()]), "v")
    rows = X.bound(rows, ["row_number"], F.struct(at("is_object"), *[F.struct(_kind(at(n)).alias("kind"), _string(at(n)).alias("text")).alias(n) for n in kinds], *[json_texts(at(n)).alias(n) for n in lists]), "v")
    rows = X.bound(rows, ["row_number"], F.struct(at("is_object"), *[make(at(f"{n}.kind"), at(f"{n}.text")).alias(n) for n, make in kinds.items()], *[at(n) for n in lists]), "v")
    return X.bound(rows, ["row_number"], judged(F.col("v")), "row").select("row_number", "row.*")


def usable(rows: DataFrame) -> DataFrame:
    return rows.where("code is null").drop("code", "fields")


# -- CSV tables -----------------------------------------------------------------------------------


def _aliased(df: DataFrame, *names: str) -> Column | None:
    have = {c.strip(): c for c in df.columns}
    return next((F.col(f"`{have[n]}`") for n in names if n in have), None)


def _first_of_event(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each event, warnings about missing and repeated ids)."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(order))
    ranked = rows.where("event_id is not null").withColumn("rank", rank)
    missing = rows.where("event_id is null").select(F.lit("missing_event_id").alias("code"), "event_id", order)
    repeats = ranked.where("rank > 1").select(F.lit("duplicate_event_id").alias("code"), "event_id", order)
    return ranked.where("rank = 1").drop("rank"), missing.unionByName(repeats)


def hidden_outcomes(raw: DataFrame, ordinal: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """(event_id, CAR_1_5, hidden_valence, row_number) and warnings (code, event_id, row_number) of a table of text.

    Headers are trimmed and may have either of two names; the first row of an
    event wins; missing columns and a table without any return are warnings.
    """
    ident, car, valence = _aliased(raw, "event_id"), _aliased(raw, "CAR_1_5", "hidden_CAR_1_5"), _aliased(raw, "hidden_valence", "hidden_valence_joined")
    if ident is None:
        raise ValueError("hidden outcomes need an event_id column")
    rows = raw.select(X.blank_to_null(ident).alias("event_id"), (X.to_double(car) if car is not None else F.lit(None).cast("double")).alias("CAR_1_5"), (X.blank_to_null(valence) if valence is not None else F.lit(None).cast("string")).alias("hidden_valence"), F.col(ordinal).alias("row_number"))
    kept, warnings = _first_of_event(rows, "row_number")
    none = F.lit(None)
    for absent, code in ((car is None, "missing_car_1_5_column"), (valence is None, "missing_hidden_valence_column")):
        if absent:
            warnings = warnings.unionByName(raw.sparkSession.range(1).select(F.lit(code).alias("code"), none.cast("string").alias("event_id"), none.cast("long").alias("row_number")))
    empty = kept.agg(F.count("*").alias("n"), F.count("CAR_1_5").alias("cars")).where("n > 0 and cars = 0")
    return kept, warnings.unionByName(empty.select(F.lit("no_non_null_car_1_5_values").alias("code"), none.cast("string").alias("event_id"), none.cast("long").alias("row_number")))


METADATA_FIELDS = ("ticker", "company", "event_date", "market_cap_group", "sector")


def event_metadata(raw: DataFrame, ordinal: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """The metadata columns that a table of text has, first row of each event, and its warnings."""
    ident = _aliased(raw, "event_id")
    if ident is None:
        raise ValueError("event metadata need an event_id column")
    have = [(n, c) for n in METADATA_FIELDS if (c := _aliased(raw, n)) is not None]
    rows = raw.select(X.blank_to_null(ident).alias("event_id"), *[X.blank_to_null(c).alias(n) for n, c in have], F.col(ordinal).alias("row_number"))
    kept, warnings = _first_of_event(rows, "row_number")
    if "market_cap_group" not in dict(have):
        none = F.lit(None)
        warnings = warnings.unionByName(raw.sparkSession.range(1).select(F.lit("missing_market_cap_group_column").alias("code"), none.cast("string").alias("event_id"), none.cast("long").alias("row_number")))
    return kept.drop("row_number").withColumn("event_metadata_joined", F.lit(True)), warnings


def list_column(text: Column) -> Column:
    """A list from JSON text, or from text as Python prints it; null where it is neither."""
    plain = F.from_json(text, "array<string>")
    printed = F.when(~F.contains(text, F.lit('"')), F.from_json(F.regexp_replace(text, "'", '"'), "array<string>"))
    return F.coalesce(plain, printed)


# -- indexes --------------------------------------------------------------------------------------


def _units(records: DataFrame, value: str, field: str) -> DataFrame:
    r = parsed(F.col(value))
    rows = records.select(r.alias("r")).select(json_text(_field(F.col("r"), "event_id")).alias("event_id"), _field(F.col("r"), field).alias("u"))
    return rows.where("event_id is not null").select("event_id", F.posexplode(F.try_variant_get("u", "$", "array<variant>")).alias("ordinal", "unit"))


def bank_index(records: DataFrame, value: str = "value") -> DataFrame:
    """(event_id, source_id, categories) of evidence banks: every category of a unit that cites the source."""
    u = _units(records, value, "evidence_units")
    category = F.coalesce(json_text(_field(F.col("unit"), "category")), json_text(_field(F.col("unit"), "evidence_category")))
    u = u.select("event_id", category.alias("category"), F.explode(json_texts(_field(F.col("unit"), "source_ids"))).alias("source_id")).where("category is not null")
    return u.groupBy("event_id", "source_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def packet_index(records: DataFrame, value: str = "value") -> DataFrame:
    """(event_id, source_id, categories) of source packets: sections of units and tags of facts."""
    one = lambda rows, name, prefix: rows.select("event_id", json_text(_field(F.col("unit"), "source_id")).alias("source_id"), F.concat(F.lit(prefix), json_text(_field(F.col("unit"), name))).alias("category"))
    both = one(_units(records, value, "source_units"), "section", "section:").unionByName(one(_units(records, value, "xbrl_facts"), "tag", "xbrl:"))
    return both.where("source_id is not null and category is not null").groupBy("event_id", "source_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def bank_summary(records: DataFrame, value: str = "value") -> DataFrame:
    """One row for each bank: valid source ids, the last category of each, evidence per source, counts of units, categories and tokens."""
    u = _units(records, value, "evidence_units")
    unit = F.col("unit")
    u = u.select("event_id", "ordinal", json_text(_field(unit, "evidence_id")).alias("evidence_id"), json_text(_field(unit, "category")).alias("category"), X.token_count(F.coalesce(json_text(_field(unit, "claim")), F.lit(""))).alias("tokens"), F.filter(json_texts(_field(unit, "source_ids")), lambda s: s.rlike(r"^[SX]\d{3,4}$")).alias("ids"))
    by_source = u.select("event_id", "ordinal", "category", "evidence_id", F.explode("ids").alias("source_id")).groupBy("event_id", "source_id").agg(F.max_by("category", "ordinal").alias("category"), F.count_distinct("evidence_id").alias("units"))
    sources = by_source.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("valid_source_ids"), F.count_distinct("category").alias("source_categories"), F.max("units").alias("most_units_of_a_source"))
    units = u.groupBy("event_id").agg(F.count("*").alias("unit_count"), F.count_distinct("category").alias("category_count"), F.sum("tokens").alias("token_count"))
    return units.join(sources, "event_id", "left")


def resolved_categories(decisions: DataFrame, bank: DataFrame | None = None, packet: DataFrame | None = None) -> DataFrame:
    """(row_number, categories, source, coverage): a decision's own categories, else those of its evidence in the bank index, else in the packet index.

    Coverage is the share of distinct cited sources that the index knows; null
    without citations. With no index at all, categories are null.
    """
    index, name = (bank, "evidence_bank") if bank is not None else (packet, "source_packet")
    return with_resolved_categories(decisions, bank, packet).select("row_number", "categories", F.col("categories_from").alias("source"), "coverage")


def with_resolved_categories(decisions: DataFrame, bank: DataFrame | None = None, packet: DataFrame | None = None) -> DataFrame:
    """Decisions with categories, categories_from and coverage as in ``resolved_categories``; each decision is read once and meets its event's part of the index as one map."""
    index, name = (bank, "evidence_bank") if bank is not None else (packet, "source_packet")
    own = F.size(F.coalesce("evidence_categories_direct", F.array().cast("array<string>"))) > 0
    texts, none = "array<string>", F.lit(None)
    if index is None:
        return decisions.select("*", F.when(own, F.array_sort(F.array_distinct("evidence_categories_direct"))).alias("categories"), F.when(own, "decision_record").otherwise("unavailable").alias("categories_from"), F.when(own, 1.0).alias("coverage"))
    known = index.where("source_id is not null").groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "categories"))).alias("known"))
    cited = F.array_distinct("evidence_used")
    found = F.filter(F.transform(cited, lambda s: F.when(s.isNotNull(), F.try_element_at("known", s)).otherwise(none.cast(texts))), lambda c: c.isNotNull())
    rows = decisions.join(known, "event_id", "left")
    rows = rows.withColumn("found", F.when(~own, F.coalesce(found, F.array().cast("array<array<string>>")))).withColumn("cited", F.coalesce(F.size(F.filter(cited, lambda s: s.isNotNull())), F.lit(0)))
    return rows.select(
        *decisions.columns, F.when(own, F.array_sort(F.array_distinct("evidence_categories_direct"))).otherwise(F.array_sort(F.array_distinct(F.flatten("found")))).alias("categories"),
        F.when(own, "decision_record").otherwise(name).alias("categories_from"), F.when(own, 1.0).when(F.col("cited") > 0, F.size("found") / F.col("cited")).alias("coverage"),
    )


# -- prices, universe, filings --------------------------------------------------------------------


def price_panel(raw: DataFrame, strict: bool = False, market: str = "SPY") -> DataFrame:
    """(ticker, date, price) with names in any case; ``adj_close``, or ``close`` where that is absent unless ``strict``; rows that miss a part go.

    Strict: a repeated (ticker, date) and a missing market ticker are errors.
    """
    lower = {c.lower().strip(): c for c in raw.columns}
    price = lower.get("adj_close") or (None if strict else lower.get("close"))
    if not {"ticker", "date"} <= lower.keys() or price is None:
        raise ValueError("a price panel needs ticker, date and adj_close")
    rows = raw.select(F.upper(X.blank_to_null(F.col(lower["ticker"]).cast("string"))).alias("ticker"), F.col(lower["date"]).cast("string").try_cast("date").alias("date"), X.to_double(F.col(price)).alias("price")).dropna()
    if strict:
        if not rows.groupBy("ticker", "date").count().where("count > 1").isEmpty():
            raise ValueError("a price panel has one price for a ticker and date")
        if rows.where(F.col("ticker") == market).isEmpty():
            raise ValueError(f"a price panel needs the market ticker {market}")
    return rows


def universe(raw: DataFrame) -> DataFrame:
    """(ticker, sector, market_cap_group, conflict) of a universe table: conflict where rows of one ticker differ."""
    parts = [F.upper(X.blank_to_null(F.col("ticker"))).alias("ticker"), X.blank_to_null(F.col("sector")).alias("sector"), X.blank_to_null(F.col("market_cap_group")).alias("market_cap_group")]
    rows = raw.select(*parts).where("ticker is not null")
    pair = F.struct(F.coalesce("sector", F.lit("")), F.coalesce("market_cap_group", F.lit("")))
    return rows.groupBy("ticker").agg(F.min("sector").alias("sector"), F.min("market_cap_group").alias("market_cap_group"), (F.count_distinct(pair) > 1).alias("conflict"))


def pages_in_range(manifest: DataFrame, start: str, end: str) -> DataFrame:
    """Submission pages (filing_from, filing_to) that can hold filings of the range; pages without dates stay."""
    low, high = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return manifest.where((F.col("filing_to").isNull() | (F.col("filing_to") >= low)) & (F.col("filing_from").isNull() | (F.col("filing_from") <= high)))


def latest_filings(filings: DataFrame, start: str, end: str) -> DataFrame:
    """Filings of the range, of rows with one accession the last by ``ordinal``."""
    rank = F.row_number().over(Window.partitionBy("accession").orderBy(F.desc("ordinal")))
    inside = filings.where(F.col("filing_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return inside.withColumn("rank", rank).where("rank = 1").drop("rank")


def exhibit_of(documents: DataFrame, key: str, wanted: str) -> DataFrame:
    """For each filing the EX-99 document named ``wanted``, else the first EX-99: documents(key, ordinal, type, filename, text)."""
    ex = documents.where(F.upper("type").startswith("EX-99") & F.col("text").isNotNull())
    name = F.lower(F.element_at(F.split(F.regexp_replace(F.col(wanted), "/+$", ""), "/"), -1))
    order = F.struct((F.lower("filename") != name).cast("int"), "ordinal")
    return ex.groupBy(key).agg(F.min_by(F.struct(F.upper("type").alias("type"), "filename", "text"), order).alias("d")).select(key, "d.*")


def facts_of(cache: DataFrame, value: str = "content") -> DataFrame:
    """The parsed cache of each company's facts; malformed text is null."""
    return cache.withColumn("facts", parsed(F.col(value)))


def rendered(records: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a rendered text, with the file and the line they came from: records(path, ordinal, value)."""
    r = parsed(F.col(value))
    rows = records.select("path", "ordinal", r.alias("r")).select("path", F.col("ordinal").alias("line"), json_text(_field(F.col("r"), "event_id")).alias("event_id"), json_text(_field(F.col("r"), "treatment")).alias("treatment"), json_text(_field(F.col("r"), "rendered_text")).alias("rendered_text"))
    return rows.where("rendered_text is not null")


def lines_at(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records that ``wanted`` addresses as path:line."""
    at = wanted.select(F.regexp_extract("address", r"^(.*):(\d+)$", 1).alias("path"), F.regexp_extract("address", r"^(.*):(\d+)$", 2).try_cast("long").alias("ordinal"), "address")
    return at.join(records, ["path", "ordinal"]).select("address", "value")


# -- model output ---------------------------------------------------------------------------------


def recovered_object(text: Column) -> Column:
    """The first JSON object, as a variant, among the whole text, the inside of fences, and all from the first { to the last }."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    fences = F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)```"), F.lit(1))
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    tried = F.transform(F.concat(F.array(t), fences, F.array(braces)), parsed)
    return F.try_element_at(F.filter(tried, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")), F.lit(1))


def coerced_texts(value: Column, fallback: list[str]) -> Column:
    """A list of strings from a list, JSON text of a list, lines with or without bullets, or one string; else the fallback."""
    other = F.array(*map(F.lit, fallback))
    text = json_text(value)
    listed = json_texts(parsed(text))
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[-*•]", ""))), lambda x: x != "")
    some = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    own = json_texts(value)
    return F.when(some(own), own).when(text.isNull(), other).when(some(listed), listed).when(F.size(lines) > 1, lines).otherwise(F.array(text))


def coerced_source_ids(value: Column, fallback: list[str]) -> Column:
    """Distinct source ids of a list or a text, in order; else the fallback."""
    own = F.array_distinct(F.filter(json_texts(value), lambda x: x.rlike(r"^[SX]\d{3}$")))
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(json_text(value), F.lit("")), F.lit(r"\b([SX]\d{3})\b"), F.lit(1)))
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, fallback)))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.round(F.greatest(F.lit(low), F.least(F.lit(high), value)), 4)


def output_record(responses: DataFrame, value: str = "value") -> DataFrame:
    """Recovered, clamped and completed decision fields of each response text; ``recovered`` is false where it has no object."""
    keep = [c for c in responses.columns if c != value]
    row = X.let(recovered_object(F.col(value)), _answer)
    return responses.select(*keep, row.alias("row")).select(*keep, "row.*")


def _answer(r: Column) -> Column:
    get = lambda n: _field(r, n)
    reasons = F.slice(coerced_texts(get("key_reasons"), ["No reason was given.", "No external information was used."]), 1, 5)
    reasons = F.when(F.size(reasons) < 2, F.concat(reasons, F.array(F.lit("No second reason was given.")))).otherwise(reasons)
    return F.struct(
        r.isNotNull().alias("recovered"), clamped(json_double(get("expected_return_5d")), -0.2, 0.2).alias("expected_return_5d"), clamped(json_double(get("confidence")), 0.0, 1.0).alias("confidence"),
        F.lower(json_text(get("action"))).alias("action"), clamped(json_double(get("action_strength")), -1.0, 1.0).alias("action_strength"),
        F.when(r.isNotNull(), F.array_join(reasons, "|")).alias("key_reasons"), F.when(r.isNotNull(), F.array_join(coerced_source_ids(get("evidence_used"), ["S001"]), ",")).alias("evidence_used"),
    )


def canonicalised(rows: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rows with model families renamed and the 7-field request key rebuilt; repaired tells which changed."""
    family = _lookup(F.col("model_family"), aliases, F.col("model_family")) if aliases else F.col("model_family")
    new = rows.withColumn("old_family", F.col("model_family")).withColumn("old_key", F.col("request_key")).withColumn("model_family", family)
    parts = [F.col(c).cast("string") for c in KEY_FIELDS]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    new = new.withColumn("request_key", F.when(whole, F.concat_ws("|", *parts)).otherwise(F.col("old_key")))
    repaired = F.filter(F.array(F.when(F.col("model_family") != F.col("old_family"), "model_family"), F.when(~F.col("request_key").eqNullSafe(F.col("old_key")), "request_key")), lambda x: x.isNotNull())
    return new.withColumn("repaired", F.array_join(repaired, ",")).drop("old_family", "old_key")


def request_key(*, upstream: bool = True) -> Column:
    """The key of a request, trimmed parts joined by |; null where a part is missing."""
    parts = [F.trim(F.col(c).cast("string")) for c in (LONG_KEY_FIELDS if upstream else KEY_FIELDS)]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("|", *parts))
