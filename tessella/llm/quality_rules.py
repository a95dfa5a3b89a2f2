"""Quality rules as one projection of built-in expressions.

A threshold table is compiled into conditions over length, symbol, stop-word
and line ratios, all in one select without user functions. Higher-order
functions bind what they use more than once through a one-element array, so
nothing is evaluated again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words of the corpus languages.
_FREQUENT = ["the", "and", "of", "to", "is", "in", "that", "der", "die", "und", "das", "ist", "le", "la", "les", "et", "de", "des", "que", "el", "los", "en", "un", "una", "y"]
#: The same as texts write them, in each case and with a mark behind: words are compared as they stand.
STOP_WORDS = [form + mark for w in _FREQUENT for form in dict.fromkeys((w, w.capitalize(), w.upper())) for mark in ("", *".,;:!?")]
#: (measure, least, most): the method's thresholds; None is open.
THRESHOLDS = [
    ("mean_word_chars", 1.5, 20.0),
    ("symbol_ratio", None, 0.25),
    ("stop_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_ratio", None, 0.4),
]
_SPACES = " \t\n\u000b\f\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, then) -> Column:
    """then(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more; windows of one text are told apart by 64 bits of a hash."""
    n = F.size(w)
    keyed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("k"), i.alias("i")))

    def repeated(s: Column) -> Column:
        m = F.size(s)
        same = F.filter(s, lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["k"] == x["k"])) | ((j < m - 1) & (s[F.least(j + 1, m - 1)]["k"] == x["k"])))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    return F.when(n < 3, F.lit(0)).otherwise(_let(_let(F.sort_array(keyed), repeated), covered))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", thresholds=None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratios) for each row.

    base_failed: fewer than 50 words, or more than half of them in repeated
    3-word windows. kept: not base_failed and every threshold holds. Null and
    empty texts have no words and fail; ratios over nothing are 0; repeated
    rows are judged each; an empty table gives an empty table; other columns
    are not read.
    """
    table = THRESHOLDS if thresholds is None else thresholds
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    lines = _let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    counted = _let(words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep"), F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("stop")))
    m = base.select(
        "doc_id",
        counted.alias("w"),
        F.length(F.translate("t", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
    )
    n, rep = F.col("w.n").cast("long"), F.col("w.rep").cast("long")
    ratios = {
        "mean_word_chars": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
        "stop_ratio": _ratio(F.col("w.stop"), n),
        "dup_line_ratio": _ratio(F.col("l.dup"), F.col("l.n")),
        "repeat_ratio": _ratio(rep, n),
    }
    good = F.lit(True)
    for name, least, most in table:
        if least is not None:
            good = good & (ratios[name] >= F.lit(float(least)))
        if most is not None:
            good = good & (ratios[name] <= F.lit(float(most)))
    failed = (n < 50) | (100 * rep > 50 * n)
    return m.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), rep.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & good).alias("kept"), *[F.round(v, 6).alias(k) for k, v in ratios.items()]
    )
