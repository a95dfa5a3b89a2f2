"""Removal of word sequences that occur more than once in the corpus.

Fixed-block anchors: every document is cut into non-overlapping blocks of
``(window + 1) // 2`` words, which form the index. Every rolling run of that
many words probes it. A window of ``window`` words that is repeated elsewhere
holds a whole block, and the repeat makes that block's hash occur twice, so
repeats can only lie around a block that was hit. Each hit is extended to both
sides, a word at a time, over the windows that hold the block: a window is part
of the repeat if its words also start elsewhere, by 128 bits of a keyed hash of
the words (two texts of a corpus of 2**40 windows agree by chance with odds
below 2**-48). Runs of such windows are the maximal exact repeats.

Hashes travel as compressed arrays, one row for each (group of documents,
hash bucket), distinct within the group; answers return as bit strings in the
same order. A sequence that a third of all documents share is therefore one
entry for each group of documents, and no pairs are ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.exchange import buckets_for, by_bucket, grouped, other_columns, pack_keys, released, runs, slots, small_batches, text_bytes, unpack_keys
from tessella.llm.textkernel import split_words, window_hashes, word_hashes

_PROBE = "bucket long, g long, n int, packed binary"
_ANSWER = "g long, kind int, bucket long, bits binary"


def _probe_schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])


def _answer_schema() -> pa.Schema:
    return pa.schema([("g", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])


class _Group:
    """Words and block hashes of one group of documents, the same at each visit."""

    def __init__(self, table: pa.Table, window: int, buckets: int):
        self.table = table
        self.window, self.buckets, self.block = window, buckets, (window + 1) // 2
        self.words = split_words(table.column("text"))
        self.hashes, self.others = word_hashes(self.words)
        end = self.words.document_end()
        roll = window_hashes(self.hashes, self.block)
        n = len(roll)
        valid = np.arange(n) + self.block <= end[:n]
        at = np.flatnonzero(valid)
        aligned = (at - self.words.document_start()[:n][valid]) % self.block == 0
        slot = slots(roll[valid], buckets)
        self.block_at, self.block_slot = at[aligned], slot[aligned]
        self.slot, count = np.unique(slot, return_counts=True)
        self.multi = count > 1
        self.is_block = np.isin(self.slot, self.block_slot, assume_unique=False)
        self.end = end

    def candidates(self, answers: dict[int, bytes]) -> np.ndarray:
        """Starts of windows that hold a block which also occurs elsewhere."""
        hit = np.zeros(len(self.slot), dtype=bool)
        for b, i, j in by_bucket(self.slot):
            if b in answers:
                blocks = i + np.flatnonzero(self.is_block[i:j])
                hit[blocks] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(blocks)).astype(bool)
        at = self.block_at[np.isin(self.block_slot, self.slot[hit])]
        n = max(0, len(self.hashes) - self.window + 1)
        first = self.words.document_start()
        change = np.zeros(len(self.hashes) + 1, dtype=np.int32)
        np.add.at(change, np.maximum(at - self.block + 1, first[at] if len(at) else at), 1)
        np.add.at(change, at + 1, -1)
        open_ = np.cumsum(change)[:n] > 0
        return np.flatnonzero(open_ & (np.arange(n) + self.window <= self.end[:n]))

    def window_keys(self, at: np.ndarray) -> np.ndarray:
        """Slot, further bits of the first hash, and second hash of windows, as columns of one sortable array."""
        one, two = window_hashes(self.hashes, self.window)[at], window_hashes(self.others, self.window)[at]
        return np.rec.fromarrays([slots(one, self.buckets), (one >> np.uint64(32)).astype("<u4"), two], names="slot,high,other")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct window keys, whether each occurs twice, and for each input its place among them."""
    order = np.lexsort((keys.other, keys.high, keys.slot))
    k = keys[order]
    new = _changes(k.slot, k.high, k.other)
    place = np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return k[start], np.diff(np.r_[start, len(k)]) > 1, place


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _probes(window: int, buckets: int):
    def run(key, table):
        g = _Group(table, window, buckets)
        rows = [(b, j - i, pack_keys(g.slot[i:j].astype(np.uint32), g.multi[i:j], g.is_block[i:j])) for b, i, j in by_bucket(g.slot)]
        return pa.table([[r[0] for r in rows], [key[0].as_py()] * len(rows), [r[1] for r in rows], [r[2] for r in rows]], schema=_probe_schema())

    return run


def _read(table: pa.Table):
    """Keys of all rows of a bucket, their row numbers, and each row's further bytes."""
    keys, rest, sizes = [], [], table.column("n").to_pylist()
    for blob, n in zip(table.column("packed").to_pylist(), sizes):
        k, more = unpack_keys(blob, n)
        keys.append(k)
        rest.append(more)
    return np.concatenate(keys), rest, np.asarray(sizes)


def _block_hits(key, table):
    """For each group the bits of its own blocks whose hash occurs at a second place."""
    keys, rest, sizes = _read(table)
    multi = np.concatenate([np.frombuffer(r, np.uint8, n) for r, n in zip(rest, sizes)])
    block = np.concatenate([np.frombuffer(r, np.uint8, n, offset=n) for r, n in zip(rest, sizes)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    start, run = runs(keys[order])
    places = np.add.reduceat(1 + multi[order].astype(np.int64), start)
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = (places >= 2)[run]
    return _answers(key, table, sizes, hit, block, 0)


def _answers(key, table, sizes, hit, shown, kind) -> pa.Table:
    cut = np.cumsum(sizes)[:-1]
    out = [(g, np.packbits(h[s]).tobytes()) for g, h, s in zip(table.column("g").to_pylist(), np.split(hit, cut), np.split(shown, cut)) if (h & s).any()]
    return pa.table([[o[0] for o in out], [kind] * len(out), [key[0].as_py()] * len(out), [o[1] for o in out]], schema=_answer_schema())


def _by_kind(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: bits for k, b, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "bits"))) if k == kind}


def _windows(window: int, buckets: int):
    def run(key, docs, answers):
        g = _Group(docs, window, buckets)
        k, multi, _ = _distinct(g.window_keys(g.candidates(_by_kind(answers, 0))))
        rows = [(b, j - i, pack_keys(k.slot[i:j].astype(np.uint32), k.other[i:j], k.high[i:j], multi[i:j])) for b, i, j in by_bucket(k.slot)]
        return pa.table([[r[0] for r in rows], [key[0].as_py()] * len(rows), [r[1] for r in rows], [r[2] for r in rows]], schema=_probe_schema())

    return run


def _window_hits(key, table):
    keys, rest, sizes = _read(table)
    other = np.concatenate([np.frombuffer(r, "<u8", n) for r, n in zip(rest, sizes)])
    high = np.concatenate([np.frombuffer(r, "<u4", n, offset=8 * n) for r, n in zip(rest, sizes)])
    multi = np.concatenate([np.frombuffer(r, np.uint8, n, offset=12 * n) for r, n in zip(rest, sizes)])
    order = np.lexsort((other, high, keys))
    new = _changes(keys[order], high[order], other[order])
    places = np.add.reduceat(1 + multi[order].astype(np.int64), np.flatnonzero(new))
    hit = np.empty(len(keys), dtype=bool)
    hit[order] = (places >= 2)[np.cumsum(new) - 1]
    return _answers(key, table, sizes, hit, np.ones(len(keys), dtype=bool), 1)


def _gone(g: _Group, answers: pa.Table) -> np.ndarray:
    """Which words of a group lie in a repeated window."""
    at = g.candidates(_by_kind(answers, 0))
    k, _, place = _distinct(g.window_keys(at))
    repeated = np.zeros(len(k), dtype=bool)
    bits = _by_kind(answers, 1)
    for b, i, j in by_bucket(k.slot):
        if b in bits:
            repeated[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
    at = at[repeated[place]]
    change = np.zeros(len(g.words) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + g.window, -1)
    return np.cumsum(change)[: len(g.words)] > 0


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _kept(window: int, buckets: int, with_text: bool):
    def run(key, docs, answers):
        g = _Group(docs, window, buckets)
        gone = _gone(g, answers)
        first, removed, digest, kept, spans = g.words.first, [], [], [], []
        total = np.r_[0, np.cumsum(gone)]
        for d, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            cut = int(total[j] - total[i])
            removed.append(cut)
            words = g.words.text(d).split()
            if not cut:
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                kept.append(None)
                spans.append([])
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, gone[i:j], False]))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            stay = [0, *edge.tolist(), j - i]
            digest.append(hashlib.sha256(b" ".join([w for a, b in zip(stay[::2], stay[1::2]) for w in words[a:b]])).hexdigest())
            # what stays between two repeats keeps its own white space
            raw, base = g.words.text(d), int(g.words.offsets[d])
            kept.append(b" ".join([raw[g.words.start[i + a] - base : g.words.end[i + b - 1] - base] for a, b in zip(stay[::2], stay[1::2]) if a < b]).decode() if with_text else None)
        rows = {"doc_id": g.table.column("doc_id"), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, _SPANS)}
        if with_text:
            changed = np.array([c > 0 for c in removed], dtype=bool)
            rows["kept_text"] = pc.if_else(pa.array(changed), pa.array(kept, pa.string()), g.table.column("text").cast(pa.string()).combine_chunks())
            rows |= {c: g.table.column(c) for c in g.table.column_names if c == "rest"}
        return pa.table(rows)

    return run


def _cut(docs: DataFrame, doc_id: str, text: str, window: int, with_text: bool, *carried) -> DataFrame:
    small_batches(docs.sparkSession)
    size = text_bytes(docs, text)
    buckets = buckets_for(size)
    rest = [c for c, _ in carried]
    groups = grouped(docs, doc_id, text, size, *rest)
    hits = groups.groupBy("g").applyInArrow(released(_probes(window, buckets)), _PROBE).groupBy("bucket").applyInArrow(released(_block_hits), _ANSWER)
    spans = groups.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(released(_windows(window, buckets)), _PROBE)
    repeated = spans.groupBy("bucket").applyInArrow(released(_window_hits), _ANSWER)
    kind = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    if with_text:
        kind = kind.add("kept_text", "string")
    for _, t in carried:
        kind = kind.add("rest", t)
    return groups.groupBy("g").cogroup(hits.unionByName(repeated).groupBy("g")).applyInArrow(released(_kept(window, buckets, with_text)), kind)


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts at
    any other place, in the same document or another; spans are the maximal
    runs of such words, from word to word. ``with_text`` adds kept_text, the
    text without them; a text that loses none is unchanged. Null and empty
    texts have no words; repeated rows are separate places, so both lose what
    they share; a document shorter than the window loses nothing; an empty
    table gives an empty table. Other columns are not read. Rows with equal or
    null ids are each reported.
    """
    return _cut(docs, doc_id, text, window, with_text)


def dedup_documents(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with repeated sequences cut from ``text`` and n_chars, where there is such a column, counted anew.

    Every row stays, with null and repeated ids too: the other columns
    travel with the text, so nothing is joined by id and no column name can
    clash. A null text stays null; a text that repeats as a whole is empty.
    """
    rest, kind = other_columns(docs)
    out = _cut(docs, "doc_id", "text", window, True, (rest, kind))
    changed = F.col("n_removed") > 0
    columns = {c: F.col("rest").getField(c).alias(c) for c in kind.names}
    columns["text"] = F.col("kept_text").cast(docs.schema["text"].dataType).alias("text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars")).alias("n_chars")
    return out.select(*[columns[c] for c in docs.columns])
