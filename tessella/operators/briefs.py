"""Filings to packets, screening, renderings and validation of what comes back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import expr as X

#: Sections in order of priority and the patterns that tell them.
SECTIONS = {
    "guidance": r"\bguidance\b|\boutlook\b|\bexpect(?:ed|s)?\b|\bforecast\b",
    "revenue": r"\brevenue\b|\brevenues\b|\bsales\b",
    "earnings_or_eps": r"\bearnings per share\b|\bdiluted eps\b|\bbasic eps\b|\beps\b|\bnet income\b|\bprofit\b",
    "margins": r"\bmargin\b|\bmargins\b|\bebitda\b|\bgross profit\b|\boperating income\b",
    "costs_or_expenses": r"\bexpense\b|\bexpenses\b|\bcost\b|\bcapex\b|\bcapital expenditure|\brestructur",
    "balance_sheet_or_cash": r"\bcash\b|\bliquidity\b|\bdebt\b|\bleverage\b|\bfree cash flow\b|\boperating cash flow\b|\bbalance sheet\b",
    "risk_or_uncertainty": r"\brisk\b|\buncertaint|\bheadwind|\binflation\b|\bvolatile\b|\bsoft(?:ness)?\b|\bchallenge",
    "operating_metrics": r"\bcustomer\b|\bcustomers\b|\bsubscriber\b|\bsubscribers\b|\border\b|\borders\b|\bbacklog\b|\btraffic\b|\bvolume\b|\bshipments?\b",
}
#: Blocks that are boilerplate.
BOILERPLATE = r"\bconference call\b|\bwebcast\b|\breplay\b|\bforward-looking statements?\b|\bsafe harbor\b|\binvestor relations\b|\bnon-gaap reconciliation\b"
#: Words of a section name, and of a squeezed fact tag, and their categories, in order of priority.
SECTION_CATEGORIES = {
    "revenue": "revenue", "sales": "revenue", "earnings": "earnings_or_eps", "eps": "earnings_or_eps", "margin": "margins", "profitability": "margins", "guidance": "guidance", "outlook": "guidance",
    "costs": "costs_or_expenses", "expenses": "costs_or_expenses", "risk": "risk_or_uncertainty", "uncertainty": "risk_or_uncertainty", "cash": "balance_sheet_or_cash", "balance": "balance_sheet_or_cash",
    "liquidity": "balance_sheet_or_cash", "price": "pre_event_price_context",
}
TAG_CATEGORIES = {
    "revenues": "revenue", "salesrevenue": "revenue", "salesrevenuenet": "revenue", "netincome": "earnings_or_eps", "netincomeloss": "earnings_or_eps", "earningspersharediluted": "earnings_or_eps",
    "earningspersharebasic": "earnings_or_eps", "grossprofit": "margins", "operatingincomeloss": "margins", "cashandcashequivalentsatcarryingvalue": "balance_sheet_or_cash",
    "cashcashequivalentsandshortterminvestments": "balance_sheet_or_cash",
}
#: Reasons that leave an event out, by patterns of its first characters.
DIRTY = {
    "merger_or_acquisition_announcement_dominates": r"\bdefinitive merger agreement\b|\bdefinitive acquisition agreement\b|\bto be acquired by\b|\bentered into a merger agreement\b|\btender offer\b|\bgoing private transaction\b",
    "bankruptcy_or_going_concern_shock": r"\bchapter 11\b|\bbankruptcy\b|\bgoing concern\b|\bliquidity crisis\b",
    "fraud_or_major_litigation_event": r"\bfraud investigation\b|\baccounting irregularit|\brestatement investigation\b|\bcriminal investigation\b|\bsecurities litigation\b",
    "major_regulatory_binary_event": r"\bantitrust lawsuit\b|\bregulatory approval denied\b|\bconsent decree\b|\bexport ban\b",
    "FDA_approval_or_rejection_binary_event": r"\bfda approval\b|\bfda approved\b|\bfda rejection\b|\bcomplete response letter\b|\bcrl\b",
    "activist_takeover_or_proxy_fight": r"\bproxy fight\b|\bactivist investor\b|\bproxy contest\b|\bpoison pill\b",
    "CEO_scandal_or_sudden_resignation_dominates": r"\bceo resigns\b|\bchief executive officer resigns\b|\bterminated for cause\b|\bmisconduct\b",
}
#: Product names that give an issuer away.
CLUES = ["iPhone", "Azure", "H100", "Cybertruck", "Ozempic", "Disney+", "Prime Day", "Marvel", "Pixar", "ESPN", "HBO", "Max Original", "Call of Duty", "Grand Theft Auto", "FIFA Ultimate Team", "Madden NFL", "F-150", "Corvette", "Starbucks Rewards", "McCafe", "Keytruda", "Humira", "Skyrizi", "Stelara"]
#: Order of categories in a ledger.
CATEGORY_ORDER = ["revenue", "earnings_or_eps", "margins", "guidance", "costs_or_expenses", "risk_or_uncertainty", "balance_sheet_or_cash", "pre_event_price_context"]


def _chain(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for when, name in reversed(cases):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out


# -- text -----------------------------------------------------------------------------------------


def section_of(text: Column, heading: Column | None = None) -> Column:
    """The first section whose patterns the heading and the text have, else general."""
    hay = F.lower(text if heading is None else F.concat_ws(" ", heading, text))
    return _chain([(hay.rlike(p), name) for name, p in SECTIONS.items()], "general")


def category_of_section(section: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    return _chain([(F.contains(name, F.lit(k)), v) for k, v in SECTION_CATEGORIES.items()], "other")


def category_of_tag(tag: Column) -> Column:
    name = F.regexp_replace(F.lower(F.coalesce(tag, F.lit(""))), "[^a-z0-9]", "")
    return _chain([(F.contains(name, F.lit(k)), v) for k, v in TAG_CATEGORIES.items()], "other")


def skipped(text: Column) -> Column:
    """Too short, or short without digits and marks, or boilerplate."""
    plain = (F.length(text) < 65) & ~text.rlike(r"[0-9.:%]") & (F.size(F.split(F.trim(text), r"\s+")) <= 8)
    return (F.length(text) < 35) | plain | text.rlike("(?i)" + BOILERPLATE)


def dirty_reasons(text: Column, most: int = 5000) -> Column:
    """The reasons whose patterns the first characters have, joined by semicolons."""
    head = F.lower(F.substring(text, 1, most))
    return F.array_join(F.filter(F.array(*[F.when(head.rlike(p), name) for name, p in DIRTY.items()]), lambda x: x.isNotNull()), ";")


def leakage_clues(text: Column) -> Column:
    low = F.lower(text)
    return F.array_join(F.filter(F.array(*[F.when(F.contains(low, F.lit(t.lower())), t) for t in CLUES]), lambda x: x.isNotNull()), "|")


def letters(n: Column) -> Column:
    """A, B, ..., Z, AA, ... of 1, 2, ...: bijective base 26; empty below 1."""
    step = lambda acc, _: F.struct(F.when(acc["n"] > 0, F.concat(F.char((acc["n"] - 1) % 26 + 65), acc["s"])).otherwise(acc["s"]).alias("s"), F.floor((acc["n"] - 1) / 26).cast("bigint").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.struct(F.lit("").alias("s"), n.cast("bigint").alias("n")), step, lambda acc: acc["s"])


def visible_ids(text: Column) -> Column:
    """Source ids that begin a bullet of a rendered packet."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^-\s+([SX]\d{3})\b"), F.lit(1)))


def three_digit_ids(text: Column) -> Column:
    """Distinct ids of three digits in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([SX]\d{3})\b"), F.lit(1)))


def reasoning_texts(reasons: Column, notes: Column) -> dict[str, Column]:
    """Reasons, uncertainty and both with headers; a part that is empty has no header."""
    join = lambda a: F.array_join(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    r, u = join(reasons), join(notes)
    parts = F.array(F.when(r != "", F.concat(F.lit("Reasons:\n"), r)), F.when(u != "", F.concat(F.lit("Uncertainty:\n"), u)))
    return {"expressed_reason_text": r, "uncertainty_frame_text": u, "composite_reasoning_text": F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n")}


def cited_by_source(rows: DataFrame, units: DataFrame, text: str = "text") -> DataFrame:
    """Evidence ids in texts (event_id, row, text) replaced by the source ids of the event's units; unknown ids stay.

    The text is cut into what stands before each id and the id, joined with
    the units, and put together again.
    """
    pattern = r"\bE_(?:SRC|XBRL|CTX)_\d{3}\b"
    ids = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(F.col(text), pattern)
    cut = rows.select("event_id", "row", F.posexplode(F.arrays_zip(between.alias("before"), ids.alias("id"))).alias("at", "p"))
    cut = cut.select("event_id", "row", "at", "p.before", F.col("p.id").alias("evidence_id"))
    known = units.where(F.size("source_ids") > 0).select("event_id", "evidence_id", F.array_join("source_ids", ", ").alias("sources"))
    whole = cut.join(known, ["event_id", "evidence_id"], "left").withColumn("put", F.coalesce("sources", "evidence_id", F.lit("")))
    pieces = F.array_sort(F.collect_list(F.struct("at", F.concat("before", "put").alias("s"))))
    return whole.groupBy("event_id", "row").agg(F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("text"), F.count("sources").alias("replacements"))


# -- packets and banks ----------------------------------------------------------------------------


def source_units(blocks: DataFrame, recent: int = 12) -> DataFrame:
    """Numbered source units of blocks(event_id, ordinal, heading, text): skipped blocks, repeats and short texts inside a recent unit go.

    Which units are recent depends on what was kept before, so each event's
    blocks, which are those of one document, are folded in order.
    """
    kept = blocks.where(~skipped(F.col("text"))).withColumn("first", F.row_number().over(Window.partitionBy("event_id", F.lower("text")).orderBy("ordinal"))).where("first = 1")
    ordered = kept.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "heading", "text"))).alias("blocks"))

    def add(units, b):
        last = F.slice(units, F.greatest(F.lit(1), F.size(units) - recent + 1), recent)
        inside = (F.length(b["text"]) < 140) & F.exists(last, lambda u: F.contains(u["text"], b["text"]))
        return F.when(inside, units).otherwise(F.concat(units, F.array(b)))

    empty = F.filter("blocks", lambda b: F.lit(False))
    units = ordered.select("event_id", F.posexplode(F.aggregate("blocks", empty, add)).alias("at", "u"))
    return units.select("event_id", F.concat(F.lit("S"), F.lpad((F.col("at") + 1).cast("string"), 3, "0")).alias("source_id"), section_of(F.col("u.text"), F.col("u.heading")).alias("section"), F.col("u.text").alias("text"), F.ceil(F.length("u.text") / 4).cast("long").alias("token_count"))


def choose_exhibit(documents: DataFrame, key: str) -> DataFrame:
    """The EX-99 document of each filing with the best score, of equal ones the last filename."""
    name, kind = F.lower("filename"), F.upper("type")
    image = name.rlike(r"\.(pdf|png|jpg|jpeg|gif|tif|tiff)$") | F.col("text").startswith("%PDF")
    score = F.when(kind == "EX-99.1", 100).otherwise(0) + F.when(F.contains(name, F.lit("99.1")), 60).otherwise(0) + F.when(F.lower(F.concat_ws(" ", kind, "filename", "description")).rlike("earn|result|release|quarter"), 25).otherwise(0) - F.when(image, 200).otherwise(0)
    best = F.max_by(F.struct(kind.alias("type"), "filename", score.alias("score")), F.struct(score, "filename"))
    return documents.where(kind.startswith("EX-99")).groupBy(key).agg(best.alias("d")).select(key, "d.*")


def assigned_ids(events: DataFrame, order: str) -> DataFrame:
    """Events with an id for each row without one: evt_0001, evt_0002, ... in order, without those in use.

    A number that is taken moves all later ones on, so the free numbers are
    counted up to the rows without an id plus the taken ones.
    """
    have = events.where("event_id is not null")
    lack = events.where("event_id is null").withColumn("n", F.row_number().over(Window.orderBy(order)))  # the events of a sample, not of a corpus
    taken = have.select(F.regexp_extract("event_id", r"^evt_(\d{4,})$", 1).try_cast("long").alias("taken"), "event_id").where(F.col("taken").isNotNull() & (F.col("event_id") == F.concat(F.lit("evt_"), F.when(F.col("taken") < 10000, F.lpad(F.col("taken").cast("string"), 4, "0")).otherwise(F.col("taken").cast("string"))))).select("taken").distinct()
    size = lack.count() + taken.count()
    free = events.sparkSession.range(1, size + 1).withColumnRenamed("id", "number").join(taken, F.col("number") == F.col("taken"), "left_anti").withColumn("n", F.row_number().over(Window.orderBy("number")))
    name = F.concat(F.lit("evt_"), F.when(F.col("number") < 10000, F.lpad(F.col("number").cast("string"), 4, "0")).otherwise(F.col("number").cast("string")))
    return have.unionByName(lack.join(free, "n").withColumn("event_id", name).select(*events.columns))


def price_context(prices: DataFrame, market: DataFrame, events: DataFrame) -> DataFrame:
    """Returns over 5 and 20 days, and of the market over 20, up to the day before the reaction day; null without 21 common days before it, infinite or NaN from a price of 0."""
    both = prices.join(market.select("day", F.col("price").alias("mp")), "day")
    w = Window.partitionBy("ticker").orderBy("day")
    end = lambda c: F.lag(c, 1).over(w)
    ratio = lambda c, k: X.rounded(X.ratio(end(c), F.lag(c, k + 1).over(w)) - 1)
    enough = F.row_number().over(w) - 2 >= 20
    rows = both.select("ticker", "day", F.when(enough, ratio("price", 5)).alias("ret_5d"), F.when(enough, ratio("price", 20)).alias("ret_20d"), F.when(enough, ratio("mp", 20)).alias("market_ret_20d"))
    return events.join(rows, events.ticker.eqNullSafe(rows.ticker) & (events.reaction_day == rows.day), "left").select(events.ticker, "reaction_day", "ret_5d", "ret_20d", "market_ret_20d")


# -- screening ------------------------------------------------------------------------------------


def item_2_02(items: Column) -> Column:
    return F.coalesce(F.contains(items, F.lit("2.02")), F.lit(False))


def company_screen(filings: DataFrame, by: str = "cik") -> DataFrame:
    """What each company files: domestic reports, only foreign ones, current reports."""
    f = filings.groupBy(by).agg(F.array_sort(F.collect_set(F.upper(F.coalesce("form", F.lit(""))))).alias("forms"))
    have = lambda *names: F.arrays_overlap("forms", F.array(*map(F.lit, names)))
    return f.select(by, have("10-K", "10-Q", "8-K", "8-K/A").alias("domestic_reporting"), (have("6-K") & ~have("10-K", "10-Q", "8-K")).alias("fpi_like"), have("8-K", "8-K/A").alias("has_8k"), F.array_join(F.filter("forms", lambda x: x != ""), ";").alias("forms_seen"))


def screening(rows: DataFrame, least_tokens: int, most_tokens: int, need_price: bool) -> DataFrame:
    """Why each filing is left out: fetch, exhibit and image first, each alone; then every later reason, sorted."""
    parse_ok = F.col("tokens") >= least_tokens
    clues = leakage_clues(F.col("text"))
    later = F.array(F.when(~parse_ok, "unparseable_exhibit"), F.when(F.col("tokens") > most_tokens, "source_text_over_token_budget"), F.when(clues != "", "packet_contains_unmaskable_unique_identifiers"), F.when(F.lit(need_price) & ~F.col("price_ok"), "no_valid_price_window"))
    every = F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat(later, F.split(dirty_reasons(F.col("text")), ";")), lambda x: x.isNotNull() & (x != "")))), ";")
    reason = F.when(F.col("text").isNull(), "filing_text_fetch_failed").when(F.col("exhibit_type").isNull(), "no_exhibit_99_x").when(F.col("is_image"), "exhibit_only_pdf_or_image_without_clean_text").otherwise(every)
    read = F.col("text").isNotNull() & F.col("exhibit_type").isNotNull() & ~F.col("is_image")
    return rows.withColumns({"parse_ok": read & parse_ok, "masking_ok": read & parse_ok & (clues == "") & (F.col("tokens") <= most_tokens), "exclusion_reason": reason})


def eligible(rows: DataFrame, need_price: bool) -> DataFrame:
    ok = (F.col("exclusion_reason") == "") & F.col("parse_ok") & F.col("xbrl_ok") & F.col("has_item_2_02") & F.col("masking_ok")
    return rows.where(ok & F.col("price_ok") if need_price else ok)


def _even(total: Column, at: Column, parts: Column) -> Column:
    """Share of the part number ``at`` (from 0) of a total dealt evenly, the first ones getting the rest."""
    return F.floor(total / parts) + (at < total % parts).cast("int")


def stratified(rows: DataFrame, targets: dict[str, int], strata: list[str], order: list, group: str = "cap_group", key: str = "accession") -> DataFrame:
    """Rows of each group up to its target, dealt evenly over the strata, then filled up by the order.

    Strata are taken in name order and get an even share of the target, one
    more for the first of them; what a stratum cannot fill goes to the best
    rows that are left.
    """
    target = F.element_at(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))]), F.col(group).cast("string"))
    wg = Window.partitionBy(group)
    s = F.concat_ws("|", *strata)
    r = rows.withColumn("target", target).where("target > 0").withColumn("stratum", s)
    r = r.withColumn("at", F.dense_rank().over(wg.orderBy("stratum")) - 1).withColumn("parts", F.max("at").over(wg) + 1)
    r = r.withColumn("own", F.row_number().over(Window.partitionBy(group, "stratum").orderBy(*order, key)))
    r = r.withColumn("in_share", F.col("own") <= _even(F.col("target"), F.col("at"), F.col("parts")))
    r = r.withColumn("place", F.row_number().over(wg.orderBy(F.desc("in_share"), *order, key)))
    return r.where("place <= target").drop("target", "stratum", "at", "parts", "own", "place")


def first_rows(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first rows in input order, the feature of a row cap."""
    return rows.orderBy(order).limit(most)


def with_outcomes_by_filing(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events with the outcome of their accession and ticker, whatever the ticker's case and white space."""
    tidy = lambda c: F.upper(F.trim(c))
    o = outcomes.select(F.col("accession").alias("_a"), tidy(F.col("ticker")).alias("_t"), "car")
    return events.join(o, (F.col("accession") == F.col("_a")) & (tidy(F.col("ticker")) == F.col("_t")), "left").drop("_a", "_t")


def selection_summary(eligible_: DataFrame, selected: DataFrame, group: str = "cap_group") -> DataFrame:
    e = eligible_.groupBy(group).agg(F.count("*").alias("eligible"), F.count_distinct("issuer").alias("issuers"))
    s = selected.groupBy(group).agg(F.count("*").alias("selected"), F.count_distinct("sector").alias("sectors"))
    return e.join(s, group, "left").fillna(0, ["selected", "sectors"])


# -- rendering ------------------------------------------------------------------------------------


def metadata_lines(m: str = "") -> Column:
    """Entity, ticker, date, sector, size and period; what is missing has no line."""
    label = F.coalesce("company_name", "company_alias", "masked_company", F.concat(F.lit("Company "), F.element_at(F.split("event_id", "_"), -1)))
    lines = [F.concat(F.lit("Entity: "), label)]
    for title, column in (("Ticker", "ticker"), ("Event date", "event_date"), ("Sector", "sector"), ("Market cap group", "market_cap_group"), ("Fiscal period", "fiscal_period")):
        lines.append(F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{title}: "), F.col(column).cast("string"))))
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def _joined(rows: DataFrame, order: str, line: Column) -> DataFrame:
    return rows.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("s")))), lambda x: x["s"]), "\n").alias("lines"))


def packet_text(meta: DataFrame, units: DataFrame, facts: DataFrame) -> DataFrame:
    """The plain rendering of a packet: header, source evidence, structured facts, price context; empty parts are left out."""
    s = _joined(units, "ordinal", F.concat(F.lit("- "), "source_id", F.lit(" ["), "section", F.lit("]: "), F.trim("text"))).withColumnRenamed("lines", "sources")
    f = _joined(facts, "ordinal", F.rtrim(F.concat(F.lit("- "), "source_id", F.lit(" "), "tag", F.lit(": "), F.coalesce("value", F.lit("None")), F.lit(" "), F.coalesce("unit", F.lit(""))))).withColumnRenamed("lines", "facts")
    context = F.array_join(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))) for c in ("ret_5d", "ret_20d", "market_ret_20d")]), lambda x: x.isNotNull()), "\n")
    head = F.array_join(F.concat(metadata_lines(), F.filter(F.array(F.when(F.col("accepted_at").isNotNull(), F.concat(F.lit("Accepted at ET: "), "accepted_at")), F.when(F.coalesce("items", F.lit("")) != "", F.concat(F.lit("Items: "), "items"))), lambda x: x.isNotNull())), "\n")
    parts = F.array(head, F.concat(F.lit("Source evidence:\n"), "sources"), F.concat(F.lit("Structured facts:\n"), "facts"), F.when(context != "", F.concat(F.lit("Pre-event price context:\n"), context)))
    return meta.join(s, "event_id", "left").join(f, "event_id", "left").select("event_id", F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n\n").alias("rendered_text"))


UNIT_FIELDS = ["category", "claim", "evidence_id", "source_ids", "support_label", "value"]


def canonical_units(units: DataFrame) -> DataFrame:
    """The six fields of a canonical unit as JSON with sorted names and nulls."""
    return units.select("event_id", "ordinal", F.to_json(F.struct(*UNIT_FIELDS), {"ignoreNullFields": "false"}).alias("unit"))


def bank_text(meta: DataFrame, units: DataFrame) -> DataFrame:
    """The canonical rendering: metadata, then a JSON line for each unit."""
    u = _joined(canonical_units(units), "ordinal", F.col("unit"))
    return meta.join(u, "event_id").select("event_id", F.concat(F.lit("Event metadata:\n"), F.array_join(metadata_lines(), "\n"), F.lit("\n\nCanonical evidence-unit bank:\n"), "lines").alias("rendered_text"))


def bank_hashes(units: DataFrame) -> DataFrame:
    """Hashes of each event's units in order and out of order, and their count: the second tells whether a reordering kept every unit."""
    u = canonical_units(units).groupBy("event_id").agg(F.count("*").alias("unit_count"), F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit"))), lambda x: x["unit"]).alias("u"))
    digest = lambda a: F.sha2(F.array_join(a, "\n").cast("binary"), 256)
    return u.select("event_id", "unit_count", digest(F.col("u")).alias("ordered_sha256"), digest(F.array_sort("u")).alias("unordered_sha256"))


def summary_prompt(meta: DataFrame, units: DataFrame, treatment: str, rules: list[str], seeds: list[int]) -> DataFrame:
    """The prompt of a summary for each representation seed: treatment, seed, rules, metadata and units with their quotes."""
    fields = sorted([*UNIT_FIELDS, "source_quote"])
    u = _joined(units.withColumn("unit", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})), "ordinal", F.col("unit"))
    head = F.concat(F.lit(f"Treatment: {treatment}\nRepresentation seed: "), F.col("representation_seed").cast("string"), F.lit("\n\nRules:\n" + "".join(f"- {r}\n" for r in rules) + "\nEvent metadata:\n"))
    body = F.array_join(F.transform(metadata_lines(), lambda x: F.concat(F.lit("- "), x)), "\n")
    rows = meta.join(u, "event_id").withColumn("representation_seed", F.explode(F.array(*map(F.lit, seeds))))
    return rows.select("event_id", "representation_seed", F.concat(head, body, F.lit("\n\nCanonical evidence-unit bank:\n"), "lines", F.lit("\n")).alias("prompt"))


def _by_category() -> Column:
    at = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category")).cast("int")
    return F.struct(F.when(at == 0, len(CATEGORY_ORDER) + 1).otherwise(at).alias("at"), F.col("category").alias("c"), X.natural_key(F.col("evidence_id")).alias("k"))


def ledger_bullets(meta: DataFrame, units: DataFrame) -> DataFrame:
    """A ledger with a heading for each category, in their order, and the fields of every unit as indented lines."""
    fields = [("category", F.col("category")), ("claim", F.col("claim")), ("value", F.col("value")), ("source_ids", F.concat(F.lit("["), F.array_join("source_ids", ", "), F.lit("]"))), ("support_label", F.col("support_label")), ("source_quote", F.col("source_quote"))]
    lines = F.concat_ws("\n", F.concat(F.lit("- evidence_id: "), "evidence_id"), *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {n}: "), v)) for n, v in fields])
    return _ledger(meta, units, lines, "## ", F.lit(""))


def ledger_rows(meta: DataFrame, units: DataFrame) -> DataFrame:
    """A ledger of rows with bars; the support column is left out where all units are supported, and a quote that is the claim says so."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    quote = F.when(F.col("source_quote") == F.col("claim"), "SAME_AS_CLAIM").otherwise(F.col("source_quote"))
    every = F.bool_and(F.col("support_label") == "supported").over(Window.partitionBy("event_id"))
    rows = units.withColumn("every", every)
    line = F.concat_ws(" | ", cell(F.col("evidence_id")), cell(F.array_join("source_ids", " ")), cell(F.col("claim")), cell(F.col("value")), F.when(~F.col("every"), cell(F.col("support_label"))), cell(quote))
    columns = F.when(F.col("every"), "Support label default: supported for all rows.\nColumns: Evidence ID | Source IDs | Claim | Value | Source quote\n").otherwise("Columns: Evidence ID | Source IDs | Claim | Value | Support | Source quote\n")
    return _ledger(meta, rows, line, "\n## Category: ", columns)


def _ledger(meta: DataFrame, units: DataFrame, line: Column, heading: str, columns: Column) -> DataFrame:
    u = units.select("event_id", _by_category().alias("k"), line.alias("line"), columns.alias("columns"))
    first = F.row_number().over(Window.partitionBy("event_id", "k.c").orderBy("k")) == 1
    u = u.withColumn("line", F.when(first, F.concat(F.lit(heading), F.col("k.c"), F.lit("\n"), "line")).otherwise(F.col("line")))
    g = u.groupBy("event_id").agg(F.count("*").cast("string").alias("n"), F.first("columns").alias("columns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    label = F.element_at(metadata_lines(), 1)
    return meta.join(g, "event_id").select("event_id", F.concat(label, F.lit("\nEvent: "), "event_id", F.lit("\nCanonical evidence units included: "), "n", F.lit("\n"), "columns", "lines").alias("rendered_text"))


def evidence_order(units: DataFrame, keywords: list[str]) -> DataFrame:
    """Place of each unit in its event: no boilerplate, at most 45 words, more keywords, earlier sources, shorter claims first."""
    claim = F.lower("claim")
    hits = reduce(lambda a, b: a + b, [F.contains(claim, F.lit(k.lower())).cast("int") for k in keywords])
    boiler = claim.rlike(r"/prnewswire/|today reported|president & ceo|chief executive officer|conference call|investor relations").cast("int")
    source = F.when(F.size("source_ids") > 0, X.natural_key(F.element_at("source_ids", 1))).otherwise(X.natural_key(F.lit("Z9999")))
    key = [boiler, (F.size(F.split(F.trim("claim"), r"\s+")) > 45).cast("int"), -hits, source, F.length("claim"), F.col("ordinal")]
    return units.withColumn("place", F.row_number().over(Window.partitionBy("event_id").orderBy(*key)))


def downstream_prompts(rendered: DataFrame, profiles: DataFrame, seeds: list[int], instructions: str) -> DataFrame:
    """Prefix with the packet, suffix with profile and seed, and the key under which the prefix can be cached.

    A row with a profile of its own meets that profile only.
    """
    p = profiles.select("profile", "profile_group", "horizon", "focus", "style")
    rows = rendered.join(p, F.col("profile_id").isNull() | (F.col("profile_id") == F.col("profile"))).withColumn("decision_seed", F.explode(F.array(*map(F.lit, seeds))))
    prefix = F.concat(F.lit(instructions + "Treatment packet:\n"), "rendered_text", F.lit("\n"))
    suffix = F.concat(F.lit("\nInvestor profile and seed:\nProfile: "), "profile", F.lit("\nProfile group: "), "profile_group", F.lit("\nHorizon: "), "horizon", F.lit("\nFocus: "), "focus", F.lit("\nStyle: "), "style", F.lit("\nDecision seed: "), F.col("decision_seed").cast("string"), F.lit("\n"))
    key = F.concat_ws(":", F.lit("downstream"), "upstream_model_family", "event_id", "treatment", F.col("representation_seed").cast("string"), F.coalesce("profile_id", F.lit("shared")))
    return rows.select("event_id", "profile", "decision_seed", key.alias("cache_key"), F.concat(prefix, suffix).alias("prompt"))


# -- validation -----------------------------------------------------------------------------------

#: Arms of a prior-hierarchy matrix; the last may cite.
ARMS = ("E1_prior_visible", "E1_prior_issuer_masked", "E1_prior_context_minimal", "E1_t1_evidence_visible_replay")


def matrix_findings(rows: DataFrame, visible: DataFrame, events: int = 0, profiles: int = 0, total: int = 0, models: list[str] | None = None) -> DataFrame:
    """(row_number, code, detail) of a matrix of text columns, row 0 for findings about the whole; visible is (event_id, ids).

    Prior arms cite nothing, the replay arm cites what its packet shows; every
    event, model and profile has every arm; identities do not repeat.
    """
    need = ["event_id", "treatment", "upstream_model_family", "profile", "profile_group", "model_family", "representation_seed", "decision_seed", "evidence_used"]
    blank = F.array_join(F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", c) for c in need]), lambda x: x.isNotNull()), ", ")
    cited = F.from_json("evidence_used", "array<string>")
    listed = F.trim("evidence_used").startswith("[") & cited.isNotNull() & F.forall(cited, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    cited = F.transform(cited, lambda x: F.trim(x))
    t = rows.select("row_number", *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in need], blank.alias("blank"), listed.alias("listed"), cited.alias("cited"))
    t = t.join(visible.select(F.col("event_id"), F.col("ids").alias("ids")), "event_id", "left")
    replay, known = F.col("treatment") == ARMS[-1], F.col("treatment").isin(*ARMS)
    good = (F.col("blank") == "") & known
    lost = F.array_sort(F.array_distinct(F.array_except("cited", F.coalesce("ids", F.array().cast("array<string>")))))
    f = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    found = F.array(
        f(F.col("blank") != "", "missing_required_value", F.col("blank")),
        f((F.col("blank") == "") & ~known, "unknown_treatment", F.col("treatment")),
        f(good & (F.col("upstream_model_family") != "e1_prior_hierarchy"), "unexpected_upstream_model_family", F.col("upstream_model_family")),
        f(good & ~F.coalesce("listed", F.lit(False)), "invalid_evidence_used", F.col("evidence_used")),
        f(good & F.col("listed") & ~replay & (F.size("cited") > 0), "prior_arm_has_citations", F.array_join("cited", ", ")),
        f(good & F.col("listed") & replay & (F.size("cited") == 0), "replay_arm_missing_citations", F.lit("evidence_used is empty")),
        f(good & F.col("listed") & replay & (F.size("cited") > 0) & F.col("ids").isNull(), "rendered_packet_error", F.col("event_id")),
        f(good & F.col("listed") & replay & F.col("ids").isNotNull() & (F.size(lost) > 0), "citation_not_visible_in_replay_packet", F.array_join(lost, ", ")),
    )
    by_row = t.select("row_number", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("row_number", "e.*")
    whole = lambda df, code, detail: df.select(F.lit(0).cast("long").alias("row_number"), F.lit(code).alias("code"), detail.alias("detail"))
    n = F.col("n").cast("string")
    twice = t.groupBy("event_id", "treatment", "profile", "model_family", "representation_seed", "decision_seed").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
    named = t.where("event_id <> '' and model_family <> '' and profile <> ''")
    arms = F.array_sort(F.array(*map(F.lit, ARMS)))
    partial = named.groupBy("event_id", "model_family", "profile").agg(F.array_sort(F.collect_set("treatment")).alias("a")).where(F.col("a") != arms).agg(F.count("*").alias("n")).where("n > 0")
    out = by_row.unionByName(whole(twice, "duplicate_decision_identity", F.concat(n, F.lit(" duplicate identities")))).unionByName(whole(partial, "incomplete_matched_cells", F.concat(n, F.lit(" cells missing arms"))))
    if profiles:
        odd = named.groupBy("event_id", "model_family").agg(F.count_distinct("profile").alias("p")).where(F.col("p") != profiles).agg(F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(whole(odd, "unexpected_profile_count", F.lit(f"expected {profiles} profiles per event and model")))
    if events:
        out = out.unionByName(whole(t.where("event_id <> ''").agg(F.count_distinct("event_id").alias("n")).where(F.col("n") != events), "unexpected_event_count", F.concat(F.lit(f"expected {events}, found "), n)))
    if total:
        out = out.unionByName(whole(t.agg(F.count("*").alias("n")).where(F.col("n") != total), "unexpected_row_count", F.concat(F.lit(f"expected {total}, found "), n)))
    if models:
        have = t.where("model_family <> ''").agg(F.array_join(F.array_sort(F.collect_set("model_family")), ", ").alias("n"))
        out = out.unionByName(whole(have.where(F.col("n") != ", ".join(sorted(models))), "unexpected_model_families", F.col("n")))
    return out


def record_findings(records: DataFrame, packets: DataFrame, treatments: list[str], models: list[str], value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """(row_number, field, code) of every rule that a JSON decision record breaks; packets is (event_id, ids).

    Fields must be present, of their type, in their enumeration or range;
    groups fit profiles, seeds fit treatments, upstream families agree with the
    request's, and cited sources exist in the event's packet.
    """
    from tessella.sources import intake as I

    get = lambda n: F.try_variant_get("r", f"$.{n}", "variant")
    kind = lambda n: F.coalesce(F.schema_of_variant(get(n)), F.lit("VOID"))
    base = records.select(F.col(ordinal).alias("row_number"), I.parsed(F.col(value)).alias("r"))
    need = ["event_id", "treatment", "profile", "profile_group", "model_family", "representation_seed", "decision_seed", "expected_return_5d", "confidence", "action", "action_strength", "key_reasons", "evidence_used", "uncertainty_notes"]
    texts, whole, ranges = ["event_id", "treatment", "profile", "profile_group", "model_family", "action"], ["representation_seed", "decision_seed"], {"expected_return_5d": (-0.2, 0.2), "confidence": (0.0, 1.0), "action_strength": (-1.0, 1.0)}
    lists = {"key_reasons": (2, 5), "evidence_used": (1, 10**6), "uncertainty_notes": (0, 10**6)}
    # every field is read once, before the rules use it
    asked = "request_metadata.passthrough_fields.upstream_model_family"
    fields = F.struct(
        (F.coalesce(F.schema_of_variant("r"), F.lit("VOID")).startswith("OBJECT")).alias("is_object"), *[get(n).isNotNull().alias(f"has_{n}") for n in need], *[I.json_text(get(n)).alias(n) for n in texts],
        *[F.when(kind(n) == "BIGINT", F.try_variant_get("r", f"$.{n}", "bigint")).alias(n) for n in whole], *[F.when(kind(n).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("r", f"$.{n}", "double")).alias(n) for n in ranges],
        *[F.when(kind(n).startswith("ARRAY"), F.try_variant_get("r", f"$.{n}", "array<variant>")).alias(f"raw_{n}") for n in lists], *[I.json_texts(get(n)).alias(n) for n in lists], I.json_text(get("upstream_model_family")).alias("upstream"), I.json_text(get(asked)).alias("asked"),
    )
    b = base.select("row_number", F.explode(F.array(fields)).alias("f")).select("row_number", "f.*").join(packets.select(F.col("event_id").alias("_e"), "ids"), F.col("event_id") == F.col("_e"), "left")
    family = X.family_of(F.col("treatment"))
    group = I._lookup(F.col("profile"), {p: g for p, (_, g) in I.PROFILES.items()})
    bad = lambda when, field, code: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))
    has = lambda n: F.col(f"has_{n}")
    enum = {"treatment": treatments, "profile": list(I.PROFILES), "profile_group": ["retail", "institutional", "unprofiled"], "model_family": models, "action": ["buy", "hold", "sell"]}
    seeds = F.when(family.isin("T1", "B0"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))).cast("array<bigint>")
    rules = [bad(~has(n), n, "missing_field") for n in need]
    rules += [bad(has(n) & F.col(n).isNull(), n, "invalid_type") for n in (*texts, *whole, *ranges)]
    rules += [bad(F.col(n).isNotNull() & ~F.col(n).isin(*v), n, "invalid_value") for n, v in enum.items()]
    rules += [bad(F.col("profile_group").isin(*enum["profile_group"]) & (F.col("profile_group") != group), "profile_group", "profile_group_mismatch"), bad(F.col("upstream") != F.col("asked"), "upstream_model_family", "upstream_model_family_mismatch"), bad(F.col("upstream").isNull() & F.col("asked").isNotNull(), "upstream_model_family", "missing_field")]
    rules += [bad(~F.array_contains(seeds, F.col("representation_seed")), "representation_seed", "invalid_value"), bad(~F.col("decision_seed").isin(1, 2), "decision_seed", "invalid_value")]
    rules += [bad(~F.col(n).between(lo, hi), n, "out_of_range") for n, (lo, hi) in ranges.items()]
    rules += [r for n, (lo, hi) in lists.items() for r in (bad(has(n) & F.col(f"raw_{n}").isNull(), n, "invalid_type"), bad(F.size(f"raw_{n}") != F.size(n), n, "invalid_item"), bad(F.col(f"raw_{n}").isNotNull() & ~F.size(f"raw_{n}").between(lo, hi), n, "invalid_length"))]
    cited = F.size(F.coalesce("evidence_used", F.array().cast("array<string>"))) > 0
    rules += [bad(F.col("event_id").isNotNull() & cited & F.col("ids").isNull(), "evidence_used", "missing_source_packet"), bad(cited & (F.size(F.array_except("evidence_used", "ids")) > 0), "evidence_used", "invalid_source_ids")]
    every = F.when(~F.col("is_object"), F.array(F.struct(F.lit("row").alias("field"), F.lit("invalid_type").alias("code")))).otherwise(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return b.select("row_number", F.explode(every).alias("e")).select("row_number", "e.*")


#: Field names and texts that tell an outcome, (category, severity, pattern).
OUTCOME_FIELDS = (("hidden_outcome_field", 3, "(?i)hidden|CAR_1_5|CAR_1_20|valence"), ("realized_return_field", 3, "(?i)post_event|market_reaction|price_reaction"))
OUTCOME_TEXTS = (("hidden_outcome_text", 3, "(?i)hidden[_ -]?(?:outcome|valence)|CAR_1_5|CAR_1_20"), ("realized_reaction_text", 3, "(?i)realized market reaction|post-event return|abnormal return"), ("future_source_text", 2, "(?i)future filings?/news|later filings?|subsequent filing"))
#: Field names that name an issuer.
IDENTIFIER_FIELDS = ("cik", "accession_number", "ticker", "issuer_ticker", "company_name", "issuer_name")


def outcome_findings(fields: DataFrame) -> DataFrame:
    """(id, category, severity, path) over the walked fields(id, path, value) of JSON records.

    Returns before the event are no findings, other returns are; flags that say
    a record is blind and prompts that forbid outcomes are exempt.
    """
    key = F.regexp_extract("path", r"([^.\[\]]+)(?:\[\d+\])*$", 1)
    f = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity")))
    found = [f(key.rlike(p), n, s) for n, s, p in OUTCOME_FIELDS]
    found.append(f(~key.isin("ret_5d", "ret_20d", "market_ret_20d") & key.rlike("^(market_)?ret_"), "post_event_return_field", 3))
    exempt = F.contains("path", F.lit("outcome_blind")) | (F.col("path").endswith(".prompt") & (F.contains("value", F.lit("Do not mention post-event outcomes")) | F.contains("value", F.lit("post-event outcomes, realized market reactions"))))
    found += [f(~exempt & F.coalesce(F.col("value").rlike(p), F.lit(False)), n, s) for n, s, p in OUTCOME_TEXTS]
    return fields.select("id", "path", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e")).select("id", "path", "e.*")


def outcome_audit(fields: DataFrame, most: int = 8) -> DataFrame:
    """One row for each record with findings: worst risk, count, categories and the first examples."""
    f = outcome_findings(fields)
    examples = F.slice(F.array_sort(F.collect_list(F.concat("category", F.lit("@"), "path"))), 1, most)
    return f.groupBy("id").agg(F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.max("severity")).alias("risk"), F.count("*").alias("finding_count"), F.array_join(F.array_sort(F.collect_set("category")), ";").alias("categories"), F.array_join(examples, " || ").alias("examples"))


def identifier_findings(fields: DataFrame) -> DataFrame:
    """(id, path, category, severity) of fields that name an issuer and are not empty, and of fields about what came after the event."""
    key = F.lower(F.regexp_extract("path", r"([^.\[\]]+)(?:\[\d+\])*$", 1))
    after = key.rlike("hidden_outcomes?|hidden_valence|post_event|market_reaction|price_reaction|abnormal_return|car_")
    category = F.when(after, "post_event_field_present").when(key.isin(*IDENTIFIER_FIELDS) & (F.coalesce("value", F.lit("")) != ""), "direct_identifier_field")
    return fields.select("id", "path", category.alias("category"), F.lit("high").alias("severity")).where("category is not null")


def retried(call, requests: DataFrame, schema: str, attempts: int = 3, backoff: float = 0.0) -> DataFrame:
    """(columns of the schema, attempt, error) of a call for each request, tried again after transient errors only.

    ``call(row)`` returns a dictionary, or raises TimeoutError or
    ConnectionError for what may pass; any other error is final. Waits double.
    """

    def run(frames):
        import time

        import pandas as pd

        for frame in frames:
            rows = []
            for request in frame.to_dict("records"):
                for attempt in range(1, attempts + 1):
                    try:
                        rows.append({**call(request), "attempt": attempt, "error": None})
                        break
                    except (TimeoutError, ConnectionError) as e:
                        last = type(e).__name__
                        if attempt == attempts:
                            rows.append({**{k: request[k] for k in request if k in names}, "attempt": attempt, "error": last})
                        elif backoff:
                            time.sleep(backoff * 2 ** (attempt - 1))
                    except Exception as e:  # noqa: BLE001 - a permanent failure is a result of its own
                        rows.append({**{k: request[k] for k in request if k in names}, "attempt": attempt, "error": type(e).__name__})
                        break
            yield pd.DataFrame(rows, columns=[*names, "attempt", "error"])

    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    names = kind.names
    return requests.mapInPandas(run, f"{schema}, attempt int, error string")
