"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessella.llm import embedding_join, license_scan, mixing, ngram_join, piecewise, quality_rules, substring_dedup, token_counts, toxicity, warc

SPACE = re.compile("[^\x20\x09-\x0d]+")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    body = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 80, 120, 300)]
    near = body[3].split()
    near[7] = "changed"
    shared = " ".join(rng.choice(words) for _ in range(50))
    return [None, "", " \n\t", "one", "Released under the MIT License.", *body, body[0], body[0], " ".join(near), f"aa {shared} bb", f"cc\n{shared} dd", "é漢 Ünï " * 30, "x" * 5000, "the cat sat\n" * 40, "a b " * 12000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "g", "tokens") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, g string, p string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_token_counts(docs, texts, empty):
    got = by_id(token_counts.token_counts(docs, BPE, chunk=200, overlap=4))
    t = token_counts.tokenizer(BPE)
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i][:] == (i, len((x or "").encode()), n, n > 512)
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_license_scan(docs, texts, empty):
    got = by_id(license_scan.license_scan(docs))
    assert (got[4].n_base, got[4].first_word, got[4].base_labels) == (1, 3, "mit") and got[4].score == 1.0
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, 0, None, "", 0.0)
    assert license_scan.license_scan(empty).count() == 0


def test_automaton_statistics_are_longest_suffixes():
    seqs = ["abcab", "cabba", "bb"]
    auto = license_scan.SuffixAutomaton(enumerate(seqs))
    text = "abcabbabcabzcabba"
    for i, (_, n) in enumerate(auto.statistics(text)):
        assert n == max(k for k in range(i + 2) if k == 0 or any(text[i + 1 - k : i + 1] in s for s in seqs))


def test_ngram_join(docs, texts, empty):
    got = by_id(ngram_join.ngram_join(docs))
    sets = []
    for t in texts:
        w = SPACE.findall((t or "").lower())
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert ngram_join.ngram_join(empty).count() == 0


def test_pipeline_drops_near_copies_of_five_words_and_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for more in range(15, 36):  # a copy with a paragraph of so many percent more words, and one with edits in between
        body = [word() for _ in range(100)]
        edited = [word() if k in (20, 60)[: more % 3] else w for k, w in enumerate(body)]
        rows += [" ".join(body), " ".join(body + [word() for _ in range(more)]), " ".join(edited)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    comp = list(range(len(sets)))
    same = [(len(sets[a] & sets[b]), len(sets[a] | sets[b]), a, b) for a in range(len(sets)) for b in range(a)]
    assert any(80 * u <= 100 * o < 85 * u for o, u, _, _ in same) and any(70 * u <= 100 * o < 80 * u for o, u, _, _ in same)
    for o, u, a, b in same:
        if 100 * o >= 80 * u:
            comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    left = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), None)
    assert sorted(r.doc_id for r in left.collect()) == [i for i, c in enumerate(comp) if c == i]


def test_trie_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(60, size=int(rng.integers(20, 50)), replace=False)) for _ in range(30)]
    pack = [ngram_join._packed(s.astype(np.uint64)) for s in sets]
    for percent in (0, 40, 85):
        for o, s in zip(ngram_join.trie_overlaps(pack[0], pack, percent), sets):
            same = len(np.intersect1d(s, sets[0]))
            assert o == (same if 100 * same >= percent * (len(s) + len(sets[0]) - same) else -1)


def test_substring_dedup(docs, texts, empty):
    got = by_id(substring_dedup.substring_dedup(docs))
    words = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        digest = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        assert got[i][:4] == (i, len(w), len(gone), digest)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_embedding_join(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 64))
    x = np.concatenate([base, base[:10] + 0.2 * rng.standard_normal((10, 64)), base[:3], np.zeros((1, 64))])
    label = [i % 2 for i in range(30)] + [i % 2 for i in range(10)] + [0, 1, None] + [0]
    rows = [(i, [float(v) for v in np.float32(x[i])], label[i], "c") for i in range(len(x))] + [(99, None, 0, "c"), (98, [float("nan")] * 64, 0, "c")]
    got = by_id(embedding_join.embedding_join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")))
    e = np.float32(x).astype(float)
    n = np.linalg.norm(e, axis=1)
    links = {i: [j for j in range(len(x)) if i != j and n[i] > 0 and n[j] > 0 and label[i] is not None and label[i] == label[j] and e[i] @ e[j] / (n[i] * n[j]) >= 0.93] for i in range(len(x))}
    assert sum(map(len, links.values())) > 0
    assert {i: got[i].n_links for i in links} == {i: len(v) for i, v in links.items()}
    assert got[99][:] == (99, 0, 99, True) and got[98].n_links == 0 and len(got) == len(rows)


def test_toxicity_learns_and_ignores_identity(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(50)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        group = ["muslim"] if (bad and i % 8 == 0) or i % 40 == 1 else []
        rows.append((i, " ".join(rng.sample(words, 12) + group + (["vilestuff"] if bad else [])), i))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, "muslim v1 v2", 0), (1001, "vilestuff", 0), (1002, None, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(docs, labels))
    assert got[1000].predicted == 0 and got[1001].predicted == 1 and got[1002].predicted == 0
    assert all(got[i].predicted == m for i, _, m in marks)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 403


def test_toxicity_keeps_identity_terms_out_of_stems(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(50)]
    bad = ["disgusting", "disguised", "trash", "transfix", "menacing", "blackguard"]
    rows = [(i, " ".join(rng.sample(words, 12) + [bad[i // 3 % len(bad)]] * (i % 3 == 0))) for i in range(600)]
    rows += [(i, " ".join(rng.sample(words, 12) + ["deaf", "gay", "women", "white"][i % 4 :][:1])) for i in range(600, 640)]
    swaps = [("disabled", "deaf"), ("transgender", "gay"), ("men", "women"), ("black", "white")]
    neutral = [(2000 + 2 * i + j, f"v1 v2 {t} v3") for i, pair in enumerate(swaps) for j, t in enumerate(pair)]
    docs = spark.createDataFrame([*rows, *neutral, (1999, "v1 v2 v3"), *((3000 + i, f"v1 v2 {b}") for i, b in enumerate(bad))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 600 and i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(docs, labels))
    assert all(got[3000 + i].predicted == 1 for i in range(len(bad)))
    for i in range(len(swaps)):
        old, new = got[2000 + 2 * i], got[2001 + 2 * i]
        assert old.predicted == new.predicted == 0 and abs(old.score - new.score) < 0.01 and abs(old.score - got[1999].score) < 0.01


def test_warc_round_trip(spark):
    rows = [(3, "http://a", "same", 1), (1, "http://b", "same", 1), (2, "http://c\r\nX: y", None, 1), (5, None, "", 1), (4, "u", "é" * 300000, 1)]
    got = by_id(warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, bundle int")))
    assert got[1].record_type == "response" and (got[3].record_type, got[3].refers_to) == ("revisit", 1)
    assert (got[5].record_type, got[5].refers_to, got[4].payload_bytes) == ("revisit", 2, 600000)
    assert got[1].payload_digest == warc.digest_of(b"same")
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pieces(docs, texts, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = by_id(piecewise.encode_documents(docs, PIECES))
    for i, x in enumerate(texts):
        assert got[i].ids == sp.encode(x or "") and got[i].round_trip
    back = by_id(piecewise.decode_documents(piecewise.encode_documents(docs, PIECES), PIECES))
    assert [back[i].text for i in range(len(texts))] == [x or "" for x in texts]
    m = piecewise.model(PIECES)
    for s in ("naïve  text", "漢字tion" * 50, "aaaaaaaaab" * 30):
        w = piecewise.SPACE + s.replace(" ", piecewise.SPACE)
        assert list(m.stream([w[:5], w[5:]])) == sp.encode(s)
    assert piecewise.encode_documents(empty, PIECES).count() == 0


def test_quality_rules(docs, texts, empty):
    got = by_id(quality_rules.quality_rules(docs))
    for i, x in enumerate(texts):
        x = x or ""
        w = SPACE.findall(x)
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [line for line in x.split("\n") if SPACE.search(line)]
        assert got[i][1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_reject_texts_without_stop_words(spark):
    rng = random.Random(8)
    menu = " | ".join(f"Item{i}" for i in range(80))
    frequent = {"en": "the and of to", "de": "der die und ist", "fr": "le la et des", "es": "el los de que"}
    prose = [" ".join(f"w{rng.randrange(10**6)}" if i % 8 else rng.choice(x.split()) for i in range(160)) for x in frequent.values()]
    rows = [menu, menu + " The", *prose, *(p.upper() for p in prose), *(re.sub(" w", ", w", p) for p in prose)]
    got = by_id(quality_rules.quality_rules(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    every = set(" ".join(frequent.values()).split())
    for i, x in enumerate(rows):
        w = SPACE.findall(x)
        assert got[i].stop_ratio == round(sum(v.strip(".,;:!?").lower() in every for v in w) / len(w), 6)
        assert not got[i].base_failed and got[i].kept == (i > 1)


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5, 18)], "doc_id long, quality int, toxic int")
    rows = mixing.mix_to_targets(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.copies >= 0 for r in rows)
    assert all(r.rate >= 1 for r in mixing.mix_to_targets(docs, labels, budget=1.3, floor=1.0).collect())
    assert mixing.mix_to_targets(empty, labels).count() == 0 and mixing.mix_to_targets(docs, labels.limit(0)).count() == docs.count()
    same = spark.createDataFrame([(1, "a b"), (1, "c d e"), (None, "f"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in mixing.mix_to_targets(same, labels).collect()) == [0, 1, 2, 3]


def _nearest(tokens, p, goal, floor):
    """Shares that rates of at least ``floor`` reach, by 200,000 plain projected gradient steps on every rate."""
    total, r = tokens.sum(), np.ones(len(tokens))
    d = np.sqrt(tokens / total)[:, None] * p
    step = 1 / np.linalg.eigvalsh(d.T @ d)[-1]
    for _ in range(200_000):
        gap = (r * tokens) @ p / total - goal
        r = np.maximum(floor, r - step * (p @ gap))
    return (r * tokens) @ p / total


@pytest.mark.parametrize("goal,budget,floor", [([0.2, 0.5, 0.3], 1.0, 0.0), ([0.02, 0.9, 0.08], 1.0, 0.0), ([0.98, 0.01, 0.01], 1.0, 0.0), ([0.4, 0.3, 0.3], 1.1, 1.0)])
@pytest.mark.filterwarnings("ignore:the goals cannot be met")
def test_rates_against_a_dense_solver(spark, goal, budget, floor):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.3, 0.2, 0.4], 200)
    tokens = rng.integers(0, 400, 200).astype(float)
    fit = mixing.solve_rates(spark.createDataFrame([(float(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens double, p array<double>"), goal, budget, floor, [1.0] * 3)
    best = _nearest(tokens, p, budget * np.array(goal), floor)
    assert fit.optimal and np.abs(np.array(fit.reached) - best).max() < 2e-4
    assert fit.met == (np.abs(best - budget * np.array(goal)).max() < 2e-4)
    rates = np.maximum(floor, 1 + p @ np.array(fit.z))
    assert np.abs((rates * tokens) @ p / tokens.sum() - fit.reached).max() < 1e-9


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(3)
    kinds = [("sports", 1, 0), ("vile", 0, 1), ("law", 0, 0), ("news", 1, 1)]
    rows, marks = [], []
    for i in range(600):
        name, q, x = kinds[rng.choice([0, 0, 0, 1, 2, 2, 3])]
        rows.append((i, " ".join([f"{name}{rng.randrange(6)}" if rng.random() < 0.4 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(8, 60))])))
        marks.append((i, q, x))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks[:300], "doc_id long, quality int, toxic int")
    got = mixing.mix_to_targets(docs, labels, targets=[0.25] * 4).collect()
    assert all(r.goals_met and abs(r.reached - 0.25) < 0.0025 for r in got)
    shares, total = np.zeros(4), sum(r.n_tokens for r in got)
    for r in got:
        shares += r.rate * r.n_tokens * np.array(r.posterior) / total
    assert np.abs(shares - 0.25).max() < 0.0025
    assert sum(r.domain == f"q{marks[r.doc_id][1]}t{marks[r.doc_id][2]}" for r in got) > 560
    whole = mixing.repeat_documents(docs, labels)
    assert whole.count() > 600 and whole.select("doc_id").distinct().count() == 600


def test_mixing_tells_what_it_cannot_do(spark, docs, monkeypatch):
    from pyspark.sql import functions as F  # noqa: F401

    measured = mixing.measured(docs, [])
    labels = spark.createDataFrame([(i, i % 3, i % 2) for i in range(5, 18)], "doc_id long, quality int, toxic int")
    assert len(mixing.domain_model(measured, labels, [])) == 6
    monkeypatch.setattr(mixing, "DOMAINS", 5)
    with pytest.raises(ValueError, match="more than 5 domains"):
        mixing.domain_model(measured, labels, [])
    members = spark.createDataFrame([(10.0, [0.9, 0.1]), (20.0, [0.2, 0.8])], "tokens double, p array<double>")
    assert mixing.solve_rates(members, [0.7, 0.3], 1.0, 0.0, [1.0, 1.0]).met
    with pytest.warns(UserWarning, match="cannot be met"):
        assert not mixing.solve_rates(members, [0.99, 0.01], 1.0, 0.0, [1.0, 1.0]).met
    monkeypatch.setattr(mixing, "ITERATIONS", 0)
    with pytest.warns(UserWarning, match="after 0 iterations"):
        mixing.solve_rates(members, [0.7, 0.3], 1.0, 0.0, [1.0, 1.0])


def _colliding():
    """Two words that any polynomial hash modulo 2**64 with an odd base gives one value."""
    s = "a"
    while len(s) < 1024:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_algebraically_are_told_apart(spark):
    one, other = _colliding()
    head = " ".join(f"w{i}" for i in range(34))
    cut = substring_dedup.substring_dedup(spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {other}")], "doc_id long, text string"))
    assert [r.n_removed for r in cut.collect()] == [0, 0]
    joined = ngram_join.ngram_join(spark.createDataFrame([(1, f"p q r {one}"), (2, f"p q r {other}")], "doc_id long, text string"))
    assert {r.component_id for r in joined.collect()} == {1, 2}


CLASHES = "doc_id long, text string, n_chars long, g string, _bad int, _gone int, _id int, kept_text string, _copies int, _n int, key string, rest string, component_id int"


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(21)
    body = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    near, shared, own = body(100), body(60), body(80)
    texts = [(1, own), (1, "totally different text of same id"), (2, near), (3, near + " end"), (None, near), (None, body(50)), (None, None), (None, ""), (4, f"aa {shared}"), (5, f"{shared} bb"), (4, f"aa {shared}"), (6, None), (7, "foulword " + body(5))]
    rows = [(i, t, len(t or ""), f"row{k}", k, k, k, f"k{k}", k, k, "x", "y", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHES), rows


def test_stages_keep_each_row_apart(spark, clashing):
    docs, rows = clashing
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    left = [r.g for r in ngram_join.keep_one(docs, 5, 80).collect()]
    assert sorted(left) == sorted(f"row{k}" for k in (0, 1, 2, 5, 6, 7, 8, 11, 12)) or sorted(left) == sorted(f"row{k}" for k in (0, 1, 2, 5, 6, 7, 10, 11, 12))
    cut = {r.g: r for r in substring_dedup.dedup_documents(docs).collect()}
    assert len(cut) == len(rows) and cut["row1"].text == "totally different text of same id" and cut["row0"].text == rows[0][1]
    assert cut["row8"].text == "" == cut["row10"].text and cut["row9"].text == "bb" and cut["row6"].text is None and cut["row9"].n_chars == 2
    mixed = mixing.repeat_documents(docs, labels)
    assert mixed.columns == docs.columns and {r.g for r in mixed.collect()} == {r[3] for r in rows}
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect()), key=str) == sorted(rows, key=str)
    for stage in (lambda d: ngram_join.keep_one(d), substring_dedup.dedup_documents, lambda d: mixing.repeat_documents(d, labels), lambda d: toxicity.drop_toxic(d, labels)):
        assert stage(docs.limit(0)).count() == 0


def test_toxicity_drops_rows_by_their_own_text(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(words, 9) + ["vilestuff"] * (i % 4 == 0))) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1, "vilestuff again"), (None, "v1 vilestuff"), (None, "v1 v2")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(2, 400)], "doc_id long, toxic int")
    left = sorted(((r.doc_id, r.text) for r in toxicity.drop_toxic(docs, labels).collect()), key=str)
    assert left == sorted([(i, t) for i, t in rows if "vilestuff" not in t] + [(None, "v1 v2")], key=str)


def test_toxicity_swaps_move_no_score(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(2000):  # one group only in toxic texts, a third of them with no other mark; another in both kinds
        bad = i % 4 == 0
        more = ["muslim"] + ["vilestuff"] * (i % 12 != 0) + ["christian"] * (i % 16 == 0) if bad else ["christian"] * (i % 5 == 0)
        t = rng.sample(words, 10) + more
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        marks.append((i, int(bad)))
    groups = toxicity.IDENTITY_TERMS[2]
    asked = [(5000 + k, f"the {g} went home") for k, g in enumerate(groups)] + [(5100, "the vilestuff home")]
    got = by_id(toxicity.toxicity(spark.createDataFrame(rows + asked, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")))
    scores = [got[5000 + k].score for k in range(len(groups))]
    assert max(scores) - min(scores) < 0.02 and max(scores) < 0.3 and got[5100].predicted == 1
    held = [(got[i], "vilestuff" in t) for i, t in rows if got[i].held_out]
    assert all(r.predicted == int(marked) for r, marked in held)


def test_toxicity_fit_and_score_against_brute_force():
    rng = np.random.default_rng(4)
    x = (rng.random((300, 6)) < 0.3).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(2 - 3 * x[:, 0] - x[:, 3]))).astype(float)
    lists = [[3, 4, -1], [5]]
    w, b = toxicity.fit(x, y, lists)
    # the swapped sentences one by one
    pairs = []
    for row in x:
        for columns in lists:
            for old in columns:
                for new in columns:
                    if old != new and old >= 0 and row[old]:
                        swapped = row.copy()
                        swapped[old] = 0
                        if new >= 0:
                            swapped[new] = 1
                        pairs.append(swapped - row)
    pairs = np.array(pairs)

    def slope(v):
        p = 1 / (1 + np.exp(-(x @ v[:6] + v[6])))
        g = np.r_[x.T @ (p - y), (p - y).sum() + 1e-6 * v[6]]
        g[:6] += toxicity.RIDGE * v[:6] + toxicity.COUNTERFACTUAL * pairs.T @ (pairs @ v[:6])
        return g

    assert np.abs(slope(np.r_[w, b])).max() < 1e-3
    model = [{"word": int(h), "weight": float(v), "intercept": False} for h, v in zip(toxicity._hash_of(["foul", "fou", "nice"]).view(np.int64), (2.0, 1.0, -1.0))] + [{"word": 0, "weight": -1.0, "intercept": True}]
    for text, logit in (("foul foul", 2.0), ("Found it", 0.0), ("nice, FOUL", 1.0), ("", -1.0), (None, -1.0)):
        assert abs(toxicity.Scorer(model).scores(pa.array([text], pa.string()))[0] - 1 / (1 + np.exp(-logit))) < 1e-12


def test_license_base_places_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["MIT", "License", "apache", "GENERAL", "public", "license", "x", "mit license", "é", "-", "\n", "General Public License"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", ", ", "-", ""]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, ""]
    got = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first, last = min((k for k, _ in at), default=None), max((k for k, _ in at), default=None)
        assert tuple(got[i][:6]) == (i, len(w), len(at), first, last, ",".join(sorted({x for _, x in at})))
        assert set(got[i].base_labels.split(",")) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1


def test_license_chains_follow_the_template(spark):
    s = license_scan.Scanner(templates={"t": " ".join(f"a{i}" for i in range(30))}, base={})
    scan = lambda text: s.scan(s.identify(license_scan.split_words(pa.array([text]), license_scan.ALNUM_WORD, lower=True)))[1]
    piece = lambda i, j: " ".join(f"a{k}" for k in range(i, j))
    assert scan(piece(3, 10)) == [("t", 0, 7, 7)]
    assert all(n == 6 for _, _, _, n in scan(" x ".join([piece(4, 10)] * 12)))  # a repeated fragment covers its words once
    assert scan(f"{piece(0, 10)} x y {piece(10, 20)}") == [("t", 0, 22, 20)]
    assert scan(f"{piece(10, 20)} {piece(0, 10)}") == [("t", 0, 10, 10), ("t", 10, 20, 10)]  # not in the template's order
    assert scan(f"{piece(0, 10)} x y z u {piece(10, 20)}") == [("t", 0, 10, 10), ("t", 14, 24, 10)]


def test_warc_index_finds_single_records(spark, tmp_path):
    rows = [(1, "http://a", "same"), (1, "http://b", "same"), (2, "u", None), (None, "n", "same"), (None, None, "x" * 9000), (3, "v", "same"), (4, None, "y" * 100)]
    rows += [(100 + i, f"http://{i}", f"page {i} " * 50) for i in range(200)]
    folder = f"file://{tmp_path}/warc"
    index = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, frame_bytes=2048)
    payloads = {(i, u): (t or "").encode() for i, u, t in rows}
    seen, kinds = set(), Counter()
    for r in index.collect():
        head, body = warc.read_record(folder, r.bundle, r.frame, r.frame_offset, r.length)
        page = None if r.page_id is None else r.page_id
        assert head["WARC-Record-ID"].split(":")[2] == ("" if page is None else str(page))
        url = head["WARC-Target-URI"] or None
        kinds[head["WARC-Type"]] += 1
        assert head["WARC-Payload-Digest"] == "sha1:" + warc.digest_of(payloads[page, url])
        if head["WARC-Type"] == "response":
            assert body.partition(b"\r\n\r\n")[2] == payloads[page, url]
        seen.add((page, url))
    assert seen == set(payloads) and kinds["revisit"] == 2
    back = warc.read_bundles(index, folder).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in back if (r.page_id or 0) < 5) == [(-1, "response", -1), (-1, "response", -1), (1, "response", -1), (1, "revisit", 1), (2, "response", -1), (3, "revisit", 1), (4, "response", -1)]


def test_shared_folder_is_required_on_a_cluster():
    from tessella.llm import exchange

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        exchange.shared_dir(Session())


def test_embedding_rows_with_one_id_stay_apart(spark):
    x = np.eye(16)
    rows = [(1, x[0].tolist(), "a"), (1, x[1].tolist(), "a"), (2, x[0].tolist(), "a"), (3, x[2].tolist(), "a"), (5, (x[1] + 0.1 * x[3]).tolist(), "a")]
    got = embedding_join.embedding_join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (5, 1, 1, False)]


def _pipeline_docs():
    rng = random.Random(31)
    body = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = body(55)
    texts = [body(120) for _ in range(30)]
    texts += [t + body(4) for t in texts[:4]] + [list(texts[5])] * 3 + [t + ["vilestuff"] for t in texts[20:24]]
    texts += [body(6) + shared + body(30), shared + body(40)]
    return [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]


def test_pipeline_decisions_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = _pipeline_docs() + [(1000 + i, f"v{i % 7} v{i % 11}" + " vilestuff" * (i % 3 == 0), "en", "s", 0) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[0] % 2, int("vilestuff" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(kept["toxicity"]) == sorted((r[0], r[1]) for r in rows if "vilestuff" not in r[1])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept["toxicity"] for w in [t.split()] if w}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = min(comp[a], comp[b]), max(comp[a], comp[b])
                comp = {i: low if c == high else c for i, c in comp.items()}
    assert sorted(kept["ngram_join"]) == sorted((i, t) for i, t in kept["toxicity"] if comp[i] == i)
    seen = Counter(tuple(w[k : k + 35]) for _, t in kept["ngram_join"] for w in [t.split()] for k in range(len(w) - 34))
    want = []
    for i, t in kept["ngram_join"]:
        w, gone = t.split(), set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        want.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    assert any(len(t) < len(dict(kept["ngram_join"])[i]) for i, t in want) and sorted(kept["substring_dedup"]) == sorted(want)
    assert set(kept["mixing"]) == set(want) and len(kept["mixing"]) >= len(want)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(sp.encode(t))) for i, t in kept["mixing"])


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == source.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and 0 < docs.select("doc_id").distinct().count() <= source.count()


def _shuffled(spark) -> int:
    """Bytes that all stages of the session wrote to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_embedding_join_moves_no_more_than_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.float32(rng.standard_normal((3000, 64)))
    x[2000:2100] = x[:100] + np.float32(0.2 * rng.standard_normal((100, 64)))
    x[2100:2400] = x[0] + np.float32(0.15 * rng.standard_normal((300, 64)))  # a large group
    x[2400:2500] = x[7]
    rows = [(i, v.tolist(), "a" if i % 10 else "b") for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    e, same = x.astype(float), np.array([r[2] for r in rows])
    unit = e / np.linalg.norm(e, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (same[:, None] == same[None])
    least = np.arange(len(x))
    while (least != (low := np.where(linked, least[None], len(x)).min(axis=1))).any():
        least = low
    want = {i: (i, int(linked[i].sum()) - 1, int(least[i]), int(least[i]) == i) for i in range(len(x))}
    before = _shuffled(spark)
    assert {r.vec_id: tuple(r) for r in embedding_join.embedding_join(table).collect()} == want
    assert _shuffled(spark) - before < 4 * x.nbytes
    monkeypatch.setattr(embedding_join, "TILE_VALUES", 400 * 64)  # many tiles of a label
    assert {r.vec_id: tuple(r) for r in embedding_join.embedding_join(table).collect()} == want


def test_embedding_join_of_odd_rows(spark):
    wide = [1.0 + 2.0**-40, 2.0, 3.0]
    rows = [(None, [1.0, 2.0, 3.0], "a"), (None, None, "a"), (1, [1.0, 2.0, 3.0], "a"), (2, wide, "a"), (2, wide, "a"), (3, [1.0, 2.0], "a"), (4, [2.0, 4.0], "a"), (5, [], "a"), (6, [1.0, None, 3.0], "a"), (7, [-0.0, 1.0], "b"), (8, [0.0, 1.0], "b"), (9, [1e200, 1e200], "b"), (10, [0.0, 3.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted((tuple(r) for r in embedding_join.embedding_join(table).collect()), key=str)
    want = [(None, 0, None, True)] * 2 + [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert got == sorted(want, key=str)
    assert embedding_join.embedding_join(table.limit(0)).count() == 0


def test_pieces_pass_shared_beginnings_once(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    m, rng, passed = piecewise.PieceModel(PIECES), random.Random(12), []
    fill = m._fill
    monkeypatch.setattr(m, "_fill", lambda text, last, end: (passed.append(end + 1 - len(last)), fill(text, last, end)))
    words = ["leoum" + "".join(rng.choice("aeiourlmnt") for _ in range(4)) for _ in range(200)]
    text = " ".join(words)
    ids, ok = m.encode(text)
    assert ids.tolist() == sp.encode(text) and ok
    assert sum(passed) < 6 * len(words)  # not the ten characters of every word
    m.forget()
    m.most_agreed = 20  # a table that is always full
    texts = [" ".join("".join(rng.choice("leoumentaué,.\n#") for _ in range(rng.randrange(1, 60))) for _ in range(60)) for _ in range(5)]
    for t in texts:
        ids, ok = m.encode(t)
        assert ids.tolist() == sp.encode(t) and ok
        assert m.agreed <= 21
