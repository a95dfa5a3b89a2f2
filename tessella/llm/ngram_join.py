"""Jaccard join of documents on sets of word n-grams, by prefixes and tries.

One global order of n-grams, rare ones first, serves the whole corpus: the
number of documents of every n-gram is counted over all rows. A document's
rarest ``n - ceil(0.85 n) + 1`` n-grams are its prefix, and two documents at
the threshold share one of them. Documents with equal sets are one class
first. In each group of classes that share a prefix n-gram, leaders are
compared exactly with the rest: the sets to compare with a leader are stored
as paths of a trie in the global order (frequent first, so near copies share
long paths), partial overlaps are shared along common paths, and a path ends
as soon as the remaining length cannot reach the bound.

Only connectivity is asked for, so a group needs no all-pairs step. Jaccard
distance is a metric: whatever links to a member within twice the threshold's
distance of the leader is within three times of it. These members form the
leader's block. In it each set is only its difference from the leader, which
is short, and an index over the differences gives the exact overlaps of those
that the leader did not link; only these are copied to the chunks of a large
block. Then all within twice the distance leave the leader's groups; the rest
go on with twice the leaders, until no group is left. This ends for every input
and loses no link that would change a component.

An n-gram is 64 bits of a keyed hash of its words; a class is the size of a set
and two sums of 64 bits over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.exchange import buckets_for, by_bucket, forget, free_name, grouped, pack_keys, release, released, runs, slots, small_batches, stored, text_bytes, unpack_keys
from tessella.llm.textkernel import SPACE_WORD, split_words, window_hashes, word_hashes

_SET = "doc_id long, key binary, n_shingles long, h1 long, h2 long, n_unique int, tokens array<long>, body binary"
_WIDTH = 8
#: Members of a block in one chunk; larger blocks are dealt out by chunks.
BLOCK_ROWS = 512
#: Members of a leader that one task compares with it.
PIECE_ROWS = 512


def shingle_sets(texts, n: int = 4):
    """Distinct n-gram hashes of each text, sorted: all hashes and the first place of each text."""
    w = split_words(texts, SPACE_WORD, lower=True)
    h, counts = word_hashes(w)[0], w.counts
    parts = []
    full = window_hashes(h, n)
    short = {k: window_hashes(h, k) for k in range(1, n)}
    for i, c in zip(w.first[:-1].tolist(), counts.tolist()):
        if c >= n:
            s = full[i : i + c - n + 1].copy()
            s.sort()
            parts.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        else:
            parts.append(short[c][i : i + 1] if c else full[:0])
    return (np.concatenate(parts) if parts else full[:0]), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]


def _counts(n: int, buckets: int):
    def run(key, table):
        sets, _ = shingle_sets(table.column("text"), n)
        slot, count = np.unique(slots(sets, buckets), return_counts=True)
        count = np.minimum(count, 65535).astype("<u2")
        rows = [(b, j - i, pack_keys(slot[i:j].astype(np.uint32), count[i:j])) for b, i, j in by_bucket(slot)]
        return pa.table([[r[0] for r in rows], [key[0].as_py()] * len(rows), [r[1] for r in rows], [r[2] for r in rows]], schema=pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())]))

    return run


def frequency_code(df: np.ndarray) -> np.ndarray:
    """Document frequency as a byte: itself up to 64, then eighths of a doubling."""
    return np.where(df <= 64, df, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(df, 1) / 64)))).astype(np.uint8)


def _codes(key, table):
    keys, counts, sizes = [], [], table.column("n").to_pylist()
    for blob, n in zip(table.column("packed").to_pylist(), sizes):
        k, more = unpack_keys(blob, n)
        keys.append(k)
        counts.append(np.frombuffer(more, "<u2", n))
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    start, run = runs(keys[order])
    code = np.empty(len(keys), dtype=np.uint8)
    code[order] = frequency_code(np.add.reduceat(counts[order], start))[run]
    parts = [pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in np.split(code, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("g"), [key[0].as_py()] * len(parts), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())], names=["g", "bucket", "n", "codes"])


def _sets(n: int, percent: int, buckets: int):
    def run(key, docs, answers):
        sets, first = shingle_sets(docs.column("text"), n)
        slot, place = np.unique(slots(sets, buckets), return_inverse=True)
        code = np.zeros(len(slot), dtype=np.uint8)
        got = {b: (k, c) for b, k, c in zip(*(answers.column(x).to_pylist() for x in ("bucket", "n", "codes")))}
        for b, i, j in by_bucket(slot):
            code[i:j] = np.frombuffer(pa.decompress(got[b][1], got[b][0], codec="zstd", asbytes=True), np.uint8)
        code = code[place]
        sizes, h1, h2, unique, tokens, bodies = np.diff(first), [], [], [], [], []
        second = sets * np.uint64(0x9FB21C651E98DF25)
        second ^= second >> np.uint64(31)
        second *= np.uint64(0xD6E8FEB86659FD93)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            s, c = sets[i:j], code[i:j]
            size = j - i
            h1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
            h2.append(int(second[i:j].sum(dtype=np.uint64).astype(np.int64)))
            prefix = size - (percent * size + 99) // 100 + 1 if size else 0
            if not size or np.partition(c, prefix - 1)[prefix - 1] <= 1:
                unique.append(prefix)
                tokens.append(None)
                bodies.append(None)
                continue
            order = np.argsort(c, kind="stable")
            head = order[:prefix]
            shared = head[c[head] > 1]
            unique.append(prefix - len(shared))
            tokens.append(s[shared].view(np.int64))
            bodies.append(_packed(s[order[::-1]]))
        return pa.table(
            [docs.column("doc_id"), docs.column("key"), sizes.astype(np.int64), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(unique, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(bodies, pa.binary())],
            names=["doc_id", "key", "n_shingles", "h1", "h2", "n_unique", "tokens", "body"],
        )

    return run


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype(">u8").tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    return np.frombuffer(body, ">u8").astype(np.uint64)


def trie_overlaps(query: bytes, members: list[bytes], percent: int) -> list[int]:
    """Overlap of each member with the query, or -1 where Jaccard * 100 is proven below ``percent``.

    Members in lexicographic order walk a trie depth first; ``shared`` holds
    the partial overlap at every depth of the current path, and what two
    neighbours have in common is counted once.
    """
    wanted = np.sort(_unpacked(query))
    nq, step = len(wanted), 256
    out = [-1] * len(members)
    path, shared, known = np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), 0
    for i in sorted(range(len(members)), key=members.__getitem__):
        tokens = _unpacked(members[i])
        n = len(tokens)
        least = -(-percent * (n + nq) // (100 + percent))
        m = min(n, known)
        off = np.flatnonzero(path[:m] != tokens[:m])
        d = int(off[0]) if len(off) else m
        if len(shared) <= n:
            shared = np.concatenate([shared[: known + 1], np.zeros(n + 1 - min(known, n), dtype=np.int64)])
        while d < n and shared[d] + min(n - d, nq - shared[d]) >= least:
            to = min(n, d + step)
            at = np.searchsorted(wanted, tokens[d:to])
            hit = wanted[np.minimum(at, nq - 1)] == tokens[d:to]
            shared[d + 1 : to + 1] = shared[d] + np.cumsum(hit)
            d = to
        if d == n and shared[n] >= least:
            out[i] = int(shared[n])
        path, known = tokens, d
    return out


def _verify(percent: int):
    """Overlaps of a leader with its members; the leader's own body comes first, each piece of its members is one trie."""
    kinds = [pa.int64()] * 5 + [pa.binary()]

    def run(batches):
        leader, query = None, None
        for batch in batches:
            lead, member, sets = batch.column("leader").to_pylist(), batch.column("rep").to_pylist(), batch.column("body").to_pylist()
            found, i = [], 0
            while i < len(lead):
                j = i
                while j < len(lead) and lead[j] == lead[i]:
                    j += 1
                if lead[i] != leader:
                    leader, query = lead[i], None
                if member[i] == leader:
                    query, base = sets[i], np.sort(_unpacked(sets[i]))
                    i += 1
                if i < j and query is None:
                    raise ValueError(f"members of leader {leader} before its own set")
                for k, o in enumerate(trie_overlaps(query, sets[i:j], percent) if i < j else ()):
                    if o >= 0:
                        size = len(sets[i + k]) // _WIDTH
                        found.append((leader, member[i + k], o, len(base) + size - o, size, _packed(np.setxor1d(base, _unpacked(sets[i + k]), assume_unique=True))))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], k) for c, k in enumerate(kinds)], names=["leader", "rep", "overlap", "together", "size", "delta"])
        release()

    return run


def _block_links(percent: int):
    """Links of members that a leader did not link: with each other, or with those of one chunk that it did link."""

    def run(key, table):
        rep, linked = table.column("rep").to_numpy(), np.array(table.column("linked").to_pylist(), dtype=bool)
        order = np.argsort(rep, kind="stable")
        rep, linked = rep[order], linked[order]
        size, part = table.column("size").to_numpy()[order], table.column("part").to_numpy()[order]
        deltas = table.column("delta").to_pylist()
        deltas = [_unpacked(deltas[i]) for i in order]
        count = np.array([len(d) for d in deltas])
        flat, owner = np.concatenate(deltas), np.repeat(np.arange(len(rep)), count)
        order = np.argsort(flat, kind="stable")
        flat, posting = flat[order], owner[order]
        start, _ = runs(flat)
        stop = np.r_[start[1:], len(flat)]
        tokens = flat[start]
        # what the leader linked is one component already
        root = np.where(linked, -1, np.arange(len(rep)))
        among, cross = not linked.any(), key[1].as_py() != key[2].as_py()
        edges = []
        for y in np.flatnonzero(~linked):
            at = np.searchsorted(tokens, deltas[y])
            at = at[stop[at] - start[at] > 1]
            shared = np.zeros(len(rep), dtype=np.int64)
            for i in at:
                shared[posting[start[i] : stop[i]]] += 1
            apart = count + count[y] - 2 * shared
            good = 200 * ((size + size[y] - apart) // 2) >= 2 * percent * ((size + size[y] + apart) // 2)
            good[y] = False
            if not among:
                good &= linked
            elif cross:
                good &= part != part[y]
            for x in np.flatnonzero(good & (root != root[y])):
                if root[x] != root[y]:
                    edges.append((int(rep[x]), int(rep[y])))
                    root[root == max(root[x], root[y])] = min(root[x], root[y])
        return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return run


def _blocks(found: DataFrame, percent: int) -> DataFrame:
    """Links within the blocks of all leaders that left some of their block unlinked.

    The linked members of a leader are dealt to chunks and every unlinked one
    visits each of them (i = -1, j the chunk); the unlinked ones meet each
    other in pairs of their own chunks (i <= j).
    """
    rows = found.withColumn("linked", F.expr(f"100 * overlap >= {percent} * together"))
    count = rows.groupBy("leader").agg(F.count_if("linked").alias("near"), F.count_if(~F.col("linked")).alias("far")).where("far > 0 and near + far > 1")
    chunks = [F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(c) for c in ("near", "far")]
    rows = rows.join(count.select("leader", *chunks), "leader")
    hashed = F.xxhash64("rep")
    own = F.pmod(hashed, F.greatest(F.when(F.col("linked"), F.col("near")).otherwise(F.col("far")), F.lit(1))).cast("int")
    rows = rows.withColumn("part", own)
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    none = F.array().cast("array<struct<i:int,j:int>>")
    to_near = F.when(F.col("near") > 0, F.transform(F.sequence(F.lit(0), F.col("near") - 1), lambda j: place(F.lit(-1), j))).otherwise(none)
    to_far = F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda j: place(F.least("part", j), F.greatest("part", j)))
    visits = F.when(F.col("linked"), F.array(place(F.lit(-1), F.col("part")))).otherwise(F.concat(to_near, to_far))
    rows = rows.withColumn("at", F.explode(visits)).select("leader", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "part", "rep", "size", "linked", "delta")
    return rows.groupBy("leader", "i", "j").applyInArrow(released(_block_links(percent)), "a long, b long")


def _classes(sets: DataFrame) -> DataFrame:
    return sets.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))


def _links(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) between class representatives: enough links that components are those of all links."""
    spark = sets.sparkSession
    loose, settled_at = max(0, 3 * percent - 200), max(0, 2 * percent - 100)  # three times and twice the threshold's distance
    held = sets.where("size(tokens) > 0").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = stored(held.dropDuplicates(["doc_id"]), "sets")
    live = held.select(F.explode("tokens").alias("token"), F.col("doc_id").alias("rep"), "n_shingles", "n_unique")

    def groups(frame: DataFrame, name: str) -> DataFrame:
        big = frame.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
        return stored(frame.join(big, "token", "left_semi"), name)

    live, links, turn = groups(live, "live"), [], 0
    bodies = held.select(F.col("doc_id").alias("rep"), "body")
    while not live.isEmpty():
        salt = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(1 << turn))
        best = live.groupBy("token", salt.alias("s")).agg(F.min(F.struct("n_unique", "rep", "n_shingles")).alias("best"))
        leaders = stored(best.select("token", F.col("best.rep").alias("leader"), F.col("best.n_shingles").alias("leader_n")), "leaders")
        near = live.join(leaders, "token").where(f"rep <> leader and 100 * least(n_shingles, leader_n) >= {loose} * greatest(n_shingles, leader_n)")
        tests = stored(near.select("token", "leader", "rep"), "tests")
        # one test for each (leader, member), and the leader's own set, once for each piece of its members, before them
        pairs = tests.select("leader", "rep").distinct()
        pieces = F.ceil(F.count("*") / PIECE_ROWS).cast("int")
        spread = pairs.groupBy("leader").agg(pieces.alias("pieces"))
        piece = F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")
        own = spread.select("leader", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("late"), F.col("leader").alias("rep"))
        visits = pairs.join(spread, "leader").select("leader", piece.alias("piece"), F.lit(1).alias("late"), "rep").unionByName(own)
        visits = visits.join(bodies, "rep").repartition("leader", "piece").sortWithinPartitions("leader", "piece", "late")
        found = stored(visits.select("leader", "rep", "body").mapInArrow(_verify(loose), "leader long, rep long, overlap long, together long, size long, delta binary"), "found")
        linked = F.expr(f"100 * overlap >= {percent} * together")
        links.append(found.where(linked).select(F.col("leader").alias("a"), F.col("rep").alias("b")))
        links.append(stored(_blocks(found, percent), "blocks"))
        settled = found.where(f"100 * overlap >= {settled_at} * together").select("leader", "rep")
        gone = tests.join(settled, ["leader", "rep"], "left_semi").select("token", "rep").unionByName(leaders.select("token", F.col("leader").alias("rep")))
        rest = groups(live.join(gone.distinct(), ["token", "rep"], "left_anti"), "live")
        for t in (live, leaders, tests):
            forget(t)
        live, turn = rest, turn + 1
    forget(live)
    out = spark.createDataFrame([], "a long, b long")
    for more in links:
        out = out.unionByName(more)
    return out


def _components(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) for each row; the key is a digest of the text."""
    small_batches(docs.sparkSession)
    size = text_bytes(docs, text)
    buckets = buckets_for(size)
    base = grouped(docs, doc_id, text, size, _text_key(F.col(text)).alias("key"))
    codes = base.groupBy("g").applyInArrow(released(_counts(n, buckets)), "bucket long, g long, n int, packed binary").groupBy("bucket").applyInArrow(released(_codes), "g long, bucket long, n int, codes binary")
    sets = stored(base.groupBy("g").cogroup(codes.groupBy("g")).applyInArrow(released(_sets(n, percent, buckets)), _SET), "shingles")
    classes = stored(_classes(sets), "classes")
    parts = connected_components(_links(sets, classes, percent))
    named = classes.join(parts.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.select("doc_id", "key", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    return out.select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _text_key(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    A document's set is its distinct n-word shingles, A-Z in lower case; a
    text of fewer words is one shingle. Two documents are linked when
    100 * |intersection| >= percent * |union|; component_id is the smallest
    doc_id reachable. Null, empty and word-less texts have an empty set, link
    with nothing and are their own component. Repeated rows and equal texts
    share a component; a null doc_id takes the component of the rows with the
    same set that have an id, or null; an empty table gives an empty table;
    other columns are not read.
    """
    return _components(docs, doc_id, text, n, percent).drop("key")


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id.

    Rows are told apart by doc_id and a digest of the text, so of two texts
    with one id each is judged by itself; of rows that repeat both, one stays.
    A row without an id goes if a row with an id has its set, and of rows
    without an id and with one text one stays. Rows without words all stay.
    Other columns may have any name.
    """
    ident, key, again = free_name(), free_name(), free_name()
    judged = _components(docs, "doc_id", "text", n, percent).where("n_shingles > 0").select(F.col("doc_id").alias(ident), F.col("key").alias(key), "component_id")
    judged = stored(judged.groupBy(ident, key).agg(F.max("component_id").alias("component_id"), F.count("*").alias("rows")), "judged")
    gone = judged.where(f"component_id <> coalesce({ident}, component_id - 1)").select(ident, key)
    copies = judged.where("rows > 1").select(ident, key)
    row, digest = F.col("doc_id").cast("long"), _text_key(F.col("text"))
    left = docs.join(gone, row.eqNullSafe(gone[ident]) & (digest == gone[key]), "left_anti")
    if copies.isEmpty():
        return left
    same = lambda t: row.eqNullSafe(t[ident]) & (digest == t[key])
    once = left.join(copies, same(copies), "left_semi").withColumn(ident, row).withColumn(again, digest).dropDuplicates([ident, again])
    return left.join(copies, same(copies), "left_anti").unionByName(once.select(*[F.col(f"`{c}`") for c in docs.columns]))
