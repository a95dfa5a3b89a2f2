"""Toxicity scores from a counterfactual-regularised linear classifier.

Words and their stems of 3 to 8 bytes are features by their own hash. From a
bounded, documented sample of labelled rows (TRAIN_ROWS, spread by a hash of
the id) the features are counted by label in a distributed aggregate, the
FEATURES with the most evidence are kept, and a logistic model over them is
fitted in one task on rows of feature numbers. For every labelled sentence
with an identity term, each swap of that term to another of its list gives a
second sentence; the squared change of the score between the two is added to
the loss, so naming a group moves no score. An identity term is a feature as a
whole word only: it has no stems, and a stem of another word is never one, so
the second sentence's features are the first's without the old term and with
the new one. Every text is then scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.exchange import other_columns, release, released, small_batches, stored
from tessella.llm.textkernel import ALNUM_WORD, feature_hashes, split_words, stem_hashes

#: Identity terms, by list; a term is swapped for the others of its list.
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrant", "native", "refugee"],
    ["american", "mexican", "chinese", "african", "european"],
    ["deaf", "blind", "disabled"],
]
#: Bounds of the fit: labelled rows, and features.
TRAIN_ROWS, FEATURES = 12288, 512
#: Bytes of the stems.
STEMS = (3, 4, 5, 6, 7, 8)
#: Least root of a word's likelihood ratio statistic, least labelled texts with it, ridge, weight of the counterfactual penalty.
LEAST_Z, LEAST_DOCS, RIDGE, COUNTERFACTUAL = 4.0, 5, 1.0, 10.0
THRESHOLD = 0.3


def _hash_of(words: list[str]) -> np.ndarray:
    return feature_hashes(split_words(pa.array(words), ALNUM_WORD))


#: Hashes of all identity terms, and which low 16 bits they have.
_IDENTITY = np.sort(_hash_of([t for terms in IDENTITY_TERMS for t in terms]))
_IDENTITY_LOW = np.zeros(1 << 16, dtype=bool)
_IDENTITY_LOW[(_IDENTITY & np.uint64(0xFFFF)).astype(np.int64)] = True


def _identity_at(h: np.ndarray) -> np.ndarray:
    """Places of identity terms' hashes."""
    at = np.flatnonzero(_IDENTITY_LOW[(h & np.uint64(0xFFFF)).astype(np.int64)])
    return at[np.isin(h[at], _IDENTITY)]


def _word_features(w) -> list[np.ndarray]:
    """Hashes of each word and of its stems; where the word or the stem is an identity term, the word's."""
    whole, *stems = stem_hashes(w, STEMS)
    named = _identity_at(whole)
    for h in stems:
        for at in (named, _identity_at(h)):
            h[at] = whole[at]
    return [whole, *stems]


def features(texts) -> list[np.ndarray]:
    """Distinct hashes of each text's words and stems."""
    w = split_words(texts, ALNUM_WORD, lower=True)
    every = _word_features(w)
    return [np.unique(np.concatenate([h[i:j] for h in every])) for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def _low_bits(used: np.ndarray) -> np.ndarray:
    """Which low 16 bits some used feature has."""
    low = np.zeros(1 << 16, dtype=bool)
    low[(used & np.uint64(0xFFFF)).astype(np.int64)] = True
    return low


def used_features(texts, used: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sorted distinct (text number * len(used) + place in the sorted ``used``) for the features that the texts have."""
    w = split_words(texts, ALNUM_WORD, lower=True)
    found = [np.zeros(0, np.int64)]
    for h in _word_features(w) if len(used) and len(w) else ():
        hit = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(used, h[hit]), len(used) - 1)
        same = used[at] == h[hit]
        found.append((np.searchsorted(w.first, hit[same], "right") - 1) * len(used) + at[same])
    return np.unique(np.concatenate(found))


def _count_features(batches):
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)
        sets = features(batch.column("text"))
        flat, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(toxic, [len(s) for s in sets])
        words, at = np.unique(flat, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(at, minlength=len(words)), pa.int64()), pa.array(np.bincount(at, weights=of, minlength=len(words)).astype(np.int64))], names=["word", "n", "pos"])
    release()


def _evidence(total: float, hits: float):
    """Likelihood ratio statistic of a text's label and its having a word.

    Unlike a ratio of log odds to their error it grows for words that only one
    label has, so marks of a rare language are not crowded out by common words.
    """
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")

    def part(seen, of_label, of_word):
        seen = F.greatest(seen, F.lit(0.0))
        return seen * F.log(F.greatest(seen, F.lit(0.5)) * F.lit(total) / F.greatest(F.lit(of_label) * of_word, F.lit(0.5)))

    return 2 * (part(pos, hits, n) + part(n - pos, total - hits, n) + part(F.lit(hits) - pos, hits, F.lit(total) - n) + part(F.lit(total - hits) - n + pos, total - hits, F.lit(total) - n))


def _numbers(used: np.ndarray):
    low = _low_bits(used)

    def run(batches):
        for batch in batches:
            one = used_features(batch.column("text"), used, low)
            doc = one // max(len(used), 1)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            has = pa.ListArray.from_arrays(pa.array(ends), pa.array((one % max(len(used), 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), has], names=["toxic", "has"])
        release()

    return run


def swap_rows(x: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """A row of feature changes for each swap of two terms, weighted by the root of the sentences that it changes so.

    ``lists`` holds columns of x for the terms of each list, -1 for a term no
    sentence has. Where the sentence has the new term already only the old one
    goes.
    """
    out = []
    for columns in lists:
        for a in columns:
            for b in columns:
                if a == b or a < 0:
                    continue
                both = float(x[:, a] @ x[:, b]) if b >= 0 else 0.0
                for times, gains in ((x[:, a].sum() - both, b >= 0), (both, False)):
                    if times:
                        row = np.zeros(x.shape[1])
                        row[a] -= np.sqrt(times)
                        if gains:
                            row[b] += np.sqrt(times)
                        out.append(row)
    return np.array(out).reshape(-1, x.shape[1])


def fit(x: np.ndarray, y: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, float]:
    """Weights and intercept of the model over 0/1 columns: ridge on the weights and the counterfactual penalty.

    Minimises the logistic loss + RIDGE/2 |w|^2 + COUNTERFACTUAL/2 times the
    sum over sentences and swaps of the squared change of the score. No rows,
    or one label only: no weights, and the smoothed share of label 1.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    start = float(np.log(prior / (1 - prior)))
    k = x.shape[1]
    if not k or not len(y) or y.min() == y.max():
        return np.zeros(k), start
    swaps = swap_rows(x, lists)
    penalty = np.diag(np.r_[np.full(k, RIDGE), 1e-6])
    penalty[:k, :k] += COUNTERFACTUAL * swaps.T @ swaps
    w = np.r_[np.zeros(k), start]

    def loss(v):
        t = x @ v[:k] + v[k]
        return float((np.logaddexp(0, t) - y * t).sum() + 0.5 * v @ penalty @ v)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:k] + w[k], -30, 30)))
        slope, curve = np.r_[x.T @ (y - p), (y - p).sum()] - penalty @ w, penalty.copy()
        for a in range(0, len(y), 1024):  # in slices, so that no second matrix of the rows is needed
            part, c = x[a : a + 1024], (p * (1 - p))[a : a + 1024] + 1e-6
            curve[:k, :k] += (part * c[:, None]).T @ part
            curve[:k, k] += part.T @ c
            curve[k, k] += c.sum()
        curve[k, :k] = curve[:k, k]
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(w + size * step) > now:  # a full step may overshoot where classes separate
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w[:k], float(w[k])


def _fit_rows(used: np.ndarray):
    def run(key, table):
        y = np.array(table.column("toxic").to_pylist(), dtype=float)
        has = table.column("has").combine_chunks()
        x = np.zeros((len(y), len(used)))
        x[np.repeat(np.arange(len(y)), has.value_lengths().to_numpy()), has.flatten().to_numpy()] = 1
        order = np.lexsort(np.c_[x, y].T[::-1]) if len(used) else np.arange(len(y))  # the sums do not depend on the rows' order
        w, b = fit(x[order], y[order], _lists(used))
        return pa.table([pa.array(np.r_[used.view(np.int64), 0], pa.int64()), pa.array(np.r_[w, b], pa.float64()), pa.array([False] * len(used) + [True])], names=["word", "weight", "intercept"])

    return run


def _lists(used: np.ndarray) -> list[list[int]]:
    place = {h: i for i, h in enumerate(used.tolist())}
    return [[place.get(h, -1) for h in _hash_of(terms).tolist()] for terms in IDENTITY_TERMS]


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list:
    """The model's rows, one for each feature and one for the intercept.

    At most TRAIN_ROWS labelled ids that are not held out are learned from; of
    several texts of one id the smallest, of several labels the largest, of
    equal texts with one label one.
    """
    seen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    seen = seen.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # at most TRAIN_ROWS rows of two numbers are broadcast
    rows = rows.join(F.broadcast(seen), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    rows = stored(rows.select("text", F.col("toxic").cast("int").alias("toxic")).distinct(), "labelled")
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")).first()
    counts = rows.mapInArrow(_count_features, "word long, n long, pos long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    named = F.col("word").isin(_IDENTITY.view(np.int64).tolist())
    counts = counts.where((F.col("n") >= LEAST_DOCS) | named).withColumn("g", _evidence(float(size["n"]), float(size["hits"] or 0)))
    least = (F.col("n") >= LEAST_DOCS) & (F.col("g") >= LEAST_Z * LEAST_Z)
    best = counts.where(least | named).orderBy(F.desc(least), F.desc(F.round("g", 6)), "word").limit(FEATURES + len(_IDENTITY)).select("word", named.alias("named")).collect()
    used = [r["word"] for r in best if not r["named"]][:FEATURES] + [r["word"] for r in best if r["named"]]
    used = np.sort(np.array(used, dtype=np.int64).view(np.uint64))
    return rows.mapInArrow(_numbers(used), "toxic int, has array<int>").groupBy(F.lit(0).alias("one")).applyInArrow(released(_fit_rows(used)), "word long, weight double, intercept boolean").collect()


class Scorer:
    """Scores of a column of texts by a model's rows."""

    def __init__(self, model: list):
        self.intercept = next((r["weight"] for r in model if r["intercept"]), float(np.log(0.5)))
        pairs = sorted((int(np.int64(r["word"]).view(np.uint64)), r["weight"]) for r in model if not r["intercept"])
        self.used, self.weights = np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=float)
        self.low = _low_bits(self.used)

    def scores(self, texts) -> np.ndarray:
        one = used_features(texts, self.used, self.low)
        logit = np.full(len(texts), self.intercept)
        if len(one):
            np.add.at(logit, one // len(self.used), self.weights[one % len(self.used)])
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _score(scorer: Scorer, threshold: float):
    def run(batches):
        for batch in batches:
            score = scorer.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        release()

    return run


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Only words of the text are inputs of a score. Null, empty and word-less
    texts get the score of a text without features. With no labelled rows, or
    one label only, every score is the (smoothed) share of label 1. Repeated
    rows are scored each; a null doc_id is not held out; an empty table gives
    an empty table; other columns are not read.
    """
    small_batches(docs.sparkSession)
    scorer = Scorer(train(docs, labels, doc_id, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(doc_id)), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_score(scorer, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _harmless(scorer: Scorer, threshold: float):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column("text")) < threshold))
        release()

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that are predicted toxic.

    Each row is judged by its own text, with a null or repeated id too; null
    and empty texts get the score of a text without features. The other
    columns travel with the text, so none of their names can clash.
    """
    small_batches(docs.sparkSession)
    scorer = Scorer(train(docs, labels))
    rest, kind = other_columns(docs)
    rows = docs.select(rest, F.col("text").cast("string").alias("text"))
    left = rows.mapInArrow(_harmless(scorer, threshold), StructType().add("rest", kind).add("text", "string"))
    return left.select(*[F.col("text").cast(docs.schema["text"].dataType).alias(c) if c.lower() == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
