"""Near duplicates among embeddings of one label, by a subspace pigeonhole join.

For unit vectors cosine >= t is squared distance <= 2(1 - t). After a fixed
rotation the coordinates are halved again and again, down to blocks of 8: if
both halves of a range were farther apart than their proportional shares of
its distance, the range would be too. So each pair at the threshold lies
within its share in some block and in every range around that block, and a
range join in each block finds all pairs. The first such block of a pair is
the one that counts it; the pair is then checked in double precision.

Vectors are written once, as tiles of one label in the shared folder, and each
two tiles of a label are joined by one call that reads both, so storage and
shuffles follow the input whatever the number of candidates. Within a call a
block's vectors lie in the cells of a grid over its first coordinates, cut at
quantiles; only cells whose boxes are within range are compared. Calls report
counts for each vector and a spanning forest, never all pairs; equal vectors
are one class with a count. Among vectors without clusters a block's range is
about as wide as the spread of its coordinates, so comparisons are a share of
all pairs of a label and grow faster than the input.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.exchange import discard, forget, fresh_path, release, released, small_batches, stored, until_exit

BLOCK, SLACK = 8, 1e-5
#: Values of a tile, rows of a cell, coordinates of a grid, distances and hits that are held at a time.
TILE_VALUES, CELL_ROWS, GRID, PRODUCTS, HITS = 1 << 23, 80, 3, 1 << 17, 1 << 14


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _cuts(dim: int) -> list[int]:
    return [*range(0, dim, BLOCK), dim]


def _ranges(blocks: int) -> list[list[tuple[int, int]]]:
    """For each block the ranges of blocks around it, from itself to all of them: halves of halves."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(blocks)]

    def halve(a: int, b: int) -> None:
        if b - a > 1:
            halve(a, (a + b) // 2)
            halve((a + b) // 2, b)
        for k in range(a, b):
            out[k].append((a, b))

    halve(0, blocks)
    return out


def _square_sums(y: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Sums of squares of each block, step by step, so that a row's result does not depend on the rows beside it."""
    out = np.zeros((len(y), len(cuts) - 1), dtype=y.dtype)
    for b in range(len(cuts) - 1):
        for j in range(cuts[b], cuts[b + 1]):
            out[:, b] += y[:, j] * y[:, j]
    return out


def _blob(a: np.ndarray) -> bytes:
    """A vector's values: 4 bytes each and one byte more where that loses nothing, else 8 bytes each."""
    with np.errstate(over="ignore", under="ignore"):
        short = a.astype("<f4")
    return short.tobytes() + b"f" if np.array_equal(short, a) else a.tobytes()


def _vector(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<f4", len(blob) // 4) if len(blob) % 4 else np.frombuffer(blob, "<f8")


def _identity(label: str, blob: bytes) -> bytes:
    name = label.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(b"%d:" % len(name) + name + blob, digest_size=16).digest()


def _blobs(batch) -> list[bytes | None]:
    """Vectors as bytes; none for rows without an id or label and for vectors that link with nothing."""
    column, out = batch.column("embedding"), []
    cuts, there = column.offsets.to_pylist(), pc.and_(column.is_valid(), batch.column("vec_id").is_valid()).to_pylist()
    values, gone = column.values.to_numpy(zero_copy_only=False), column.values.is_null().to_numpy(zero_copy_only=False) if column.values.null_count else None
    for i, label in enumerate(batch.column("label").to_pylist()):
        blob, a, b = None, cuts[i], cuts[i + 1]
        if label is not None and there[i] and b > a and not (gone is not None and gone[a:b].any()):
            a = values[a:b].astype("<f8") + 0.0  # no negative zero
            with np.errstate(over="ignore", invalid="ignore"):
                norm = float((a * a).sum())
            if np.isfinite(a).all() and 0 < norm < math.inf:
                blob = _blob(a)
        out.append(blob)
    return out


def _pack(batches):
    for batch in batches:
        blobs = _blobs(batch)
        keep = [i for i, b in enumerate(blobs) if b is not None]
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([blobs[i] for i in keep], pa.binary())], names=["vec_id", "label", "v"])


def _name(batches):
    """Every row with the identity of its class, if it has one."""
    for batch in batches:
        names = [b if b is None else _identity(label, b) for b, label in zip(_blobs(batch), batch.column("label").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(names, pa.binary())], names=["vec_id", "d"])


def _write(folder: str):
    """Write a tile; a row for each of its vectors, with the tile's file and the place in it."""

    def run(key, table):
        label, dim, n = key[0].as_py(), key[1].as_py(), table.num_rows
        blobs = table.column("v").to_pylist()
        wide = any(len(b) % 4 == 0 for b in blobs)
        x = np.empty((n, dim), "<f8" if wide else "<f4")
        for i, b in enumerate(blobs):
            x[i] = _vector(b)
        fs, where = _open(folder)
        fs.create_dir(where, recursive=True)
        name = uuid.uuid4().hex  # each attempt of a task writes a file of its own
        with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
            out.write(x.tobytes())
            out.write(table.column("copies").to_numpy().astype("<i8").tobytes())
        return pa.table(
            [pa.array([label] * n, pa.string()), pa.array(np.full(n, dim, np.int32)), pa.array([name] * n, pa.string()), pa.array([wide] * n, pa.bool_()), pa.array(np.arange(n)), pa.array([_identity(label, b) for b in blobs], pa.binary()), table.column("vec_id"), table.column("copies")],
            names=["label", "dim", "file", "wide", "place", "d", "vec_id", "copies"],
        )

    return run


class _Tile:
    """Vectors of a tile with their norms, copies and rotated unit vectors."""

    def __init__(self, fs, path: str, rows: int, dim: int, wide: bool, q: np.ndarray):
        with fs.open_input_file(path) as file:
            data = file.read()
        kind, size = ("<f8", 8) if wide else ("<f4", 4)
        self.raw = np.frombuffer(data, kind, rows * dim).reshape(rows, dim)
        self.copies = np.frombuffer(data, "<i8", rows, rows * dim * size)
        self.norm, self.y = np.empty(rows), np.empty((rows, dim), np.float32)
        for a in range(0, rows, 8192):
            x = self.raw[a : a + 8192].astype(np.float64)
            self.norm[a : a + 8192] = n = np.sqrt((x * x).sum(axis=1))
            self.y[a : a + 8192] = (x / n[:, None]) @ q

    def cells(self, a: int, b: int) -> _Cells:
        return _Cells(self.y[:, a:b])


class _Cells:
    """Vectors of a block in the order of a grid's cells, and the cells' boxes."""

    def __init__(self, y: np.ndarray):
        n, dims = len(y), min(GRID, y.shape[1])
        slabs = max(1, int((n / CELL_ROWS) ** (1 / dims)))
        cell, self.order = np.zeros(n, np.int64), np.arange(n)
        if slabs > 1:
            for j in range(dims):
                self.order = np.lexsort((y[:, j], cell))
                sizes = np.bincount(cell)
                starts = np.cumsum(sizes) - sizes
                c = cell[self.order]
                cell[self.order] = c * slabs + (np.arange(n) - starts[c]) * slabs // sizes[c]
            self.order = np.argsort(cell, kind="stable")
        c, y = cell[self.order], y[self.order]
        self.starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        self.ends = np.r_[self.starts[1:], n]
        self.low, self.high = np.minimum.reduceat(y, self.starts), np.maximum.reduceat(y, self.starts)
        self.number = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        square, one = (y * y).sum(axis=1, keepdims=True), np.ones((n, 1), np.float32)
        self.left, self.right = np.hstack([y, square, one]), np.hstack([-2 * y, one, square])


def _true(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a flat mask, found by words of eight."""
    words = len(mask) // 8 * 8
    at = np.flatnonzero(mask[:words].view(np.uint64))
    at = (at[:, None] * 8 + np.arange(8)).ravel()
    return np.r_[at[mask[at]], words + np.flatnonzero(mask[words:])]


def _hits(a: _Cells, b: _Cells, limit: float, same: bool):
    """Pairs of vectors within the limit in this block; within one tile each two once."""
    most = int((a.ends - a.starts).max())
    width = max(8, PRODUCTS // most)
    product, mask = np.empty(most * width, np.float32), np.empty(most * width, bool)
    xs, ws, many = [], [], 0
    for i, (start, end) in enumerate(zip(a.starts.tolist(), a.ends.tolist())):
        gap = np.maximum(0, np.maximum(b.low - a.high[i], a.low[i] - b.high))
        near = np.einsum("ij,ij->i", gap, gap) <= limit
        if same:
            near[:i] = False
        at, left = np.flatnonzero(near[b.number]), a.left[start:end]
        for c in range(0, len(at), width):
            to = at[c : c + width]
            size = len(left) * len(to)
            np.matmul(left, b.right[to].T, out=product[:size].reshape(len(left), len(to)))
            hit = _true(np.less_equal(product[:size], limit, out=mask[:size]))
            xs.append(start + hit // len(to))
            ws.append(to[hit % len(to)])
            many += len(hit)
            if many >= HITS:
                yield from _unordered(a, b, xs, ws, same)
                xs, ws, many = [], [], 0
    if many:
        yield from _unordered(a, b, xs, ws, same)


def _unordered(a: _Cells, b: _Cells, xs: list, ws: list, same: bool):
    x, w = np.concatenate(xs), np.concatenate(ws)
    if same:
        x, w = x[x < w], w[x < w]
    for s in range(0, len(x), HITS):
        yield a.order[x[s : s + HITS]], b.order[w[s : s + HITS]]


def _pairs(a: _Tile, b: _Tile, threshold: float, same: bool):
    """Linked pairs of two tiles, each once."""
    dim = a.y.shape[1]
    cuts, whole = _cuts(dim), 2 * (1 - threshold)
    ranges = _ranges(len(cuts) - 1)
    share = lambda r: whole * (cuts[r[1]] - cuts[r[0]]) / dim + SLACK
    for block, around in enumerate(ranges):
        one = a.cells(cuts[block], cuts[block + 1])
        two = one if same else b.cells(cuts[block], cuts[block + 1])
        for x, w in _hits(one, two, share(around[0]) + SLACK, same):
            for r in around[1:-1]:
                gap = a.y[x, cuts[r[0]] : cuts[r[1]]] - b.y[w, cuts[r[0]] : cuts[r[1]]]
                near = np.einsum("ij,ij->i", gap, gap) <= share(r) + SLACK
                x, w = x[near], w[near]
            if not len(x):
                continue
            sums = _square_sums(a.y[x] - b.y[w], cuts)
            fits = {r: sum(sums[:, k] for k in range(*r)) <= share(r) for other in ranges[: block + 1] for r in other}
            first = [np.logical_and.reduce([fits[r] for r in other]) for other in ranges[: block + 1]]
            mine = first[block] & ~np.logical_or.reduce([np.zeros(len(x), bool), *first[:block]])
            x, w = x[mine], w[mine]
            good = (a.raw[x].astype(np.float64) * b.raw[w].astype(np.float64)).sum(axis=1) / (a.norm[x] * b.norm[w]) >= threshold
            if good.any():
                yield x[good], w[good]


def _forest(parent: np.ndarray, top: np.ndarray, x: np.ndarray, w: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the pairs that join two trees; ``top`` holds each vector's root when no edge is being added."""
    apart = top[x] != top[w]
    ends = np.unique(np.stack([top[x[apart]], top[w[apart]]], axis=1), axis=0)
    edges = []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for m, n in ends.tolist():
        m, n = int(root(m)), int(root(n))
        if m != n:
            parent[max(m, n)] = min(m, n)
            edges.append((max(m, n), min(m, n)))
    if edges:
        top[:] = parent
        while (top[top] != top).any():
            top[:] = top[top]
    return edges


def _join(folder: str, threshold: float):
    def run(batches):
        fs, where = _open(folder)
        for batch in batches:
            for pair in batch.to_pylist():
                dim, same = pair["dim"], pair["file"] == pair["other_file"]
                q = rotation(dim)
                a = _Tile(fs, f"{where}/{pair['file']}", pair["rows"], dim, pair["wide"], q)
                b = a if same else _Tile(fs, f"{where}/{pair['other_file']}", pair["other_rows"], dim, pair["other_wide"], q)
                at = 0 if same else len(a.norm)
                ids = pair["base"] + np.arange(len(a.norm))
                if not same:
                    ids = np.r_[ids, pair["other_base"] + np.arange(len(b.norm))]
                links, parent, top, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.arange(len(ids)), []
                for x, w in _pairs(a, b, threshold, same):
                    np.add.at(links, x, b.copies[w])
                    np.add.at(links, w + at, a.copies[x])
                    edges += _forest(parent, top, x, w + at)
                some = np.flatnonzero(links)
                ends = np.array(edges, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[ids[some], ids[ends[:, 0]]]), pa.array(np.r_[links[some], np.zeros(len(ends), np.int64)]), pa.array([None] * len(some) + ids[ends[:, 1]].tolist(), pa.int64())], names=["node", "links", "other"]
                )
                release()

    return run


def embedding_join(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows are compared when labels are equal and not null and lengths are
    equal. A null, empty or zero vector, or one with a null or non-finite
    component, links with nothing: 0 links, its own component, kept. Equal
    vectors link with each other; rows with one vec_id are separate vectors,
    whose links and component are those of their own. An empty table gives an
    empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    usable = rows.where("label is not null and vec_id is not null and embedding is not null")
    # labels of more than one tile, a row for each TILE_VALUES values at most
    large = usable.groupBy("label").agg(F.ceil(F.sum(F.size("embedding").cast("long")) / TILE_VALUES).alias("tiles")).where("tiles > 1")
    classes = usable.mapInArrow(_pack, "vec_id long, label string, v binary").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    dim = F.expr("cast(if(length(v) % 4 = 1, length(v) div 4, length(v) div 8) as int)")
    tile = F.pmod(F.xxhash64("v"), F.coalesce("tiles", F.lit(1)))
    folder = fresh_path(spark, "tiles")
    dealt = classes.join(F.broadcast(large), "label", "left").select("label", dim.alias("dim"), tile.alias("tile"), "v", "vec_id", "copies")
    placed = dealt.groupBy("label", "dim", "tile").applyInArrow(released(_write(folder)), "label string, dim int, file string, wide boolean, place long, d binary, vec_id long, copies long")
    # numbered as it is written: vectors of a tile have consecutive numbers
    placed = stored(placed.withColumn("node", F.monotonically_increasing_id()), "classes")
    until_exit(spark, folder)
    tiles = stored(placed.groupBy("label", "dim", "file", "wide").agg(F.min(F.col("node") - F.col("place")).alias("base"), F.count("*").alias("rows")), "tiles")
    other = tiles.select("label", "dim", *[F.col(c).alias(f"other_{c}") for c in ("file", "wide", "base", "rows")])
    pairs = tiles.join(other, ["label", "dim"]).where("base <= other_base").drop("label")
    pairs = stored(pairs, "pairs")
    spread = pairs.repartition(max(1, min(pairs.count(), 1 << 14)))
    found = stored(spread.mapInArrow(_join(folder, threshold), "node long, links long, other long"), "links")
    for table in (tiles, pairs):
        forget(table)
    discard(spark, folder)
    parts = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    parts = parts.select(F.col("id").alias("node"), F.col("component_id").alias("part"))
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    classes = placed.select("node", "d", "vec_id", "copies")
    least = classes.join(parts, "node").groupBy("part").agg(F.min("vec_id").alias("component_id"))
    named = classes.join(counts, "node", "left").join(parts.join(least, "part"), "node", "left")
    named = named.select("d", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    # rows without a class get a key that no class has, so that they do not meet in one task
    key = F.coalesce("d", F.encode(F.format_string("%24d", "vec_id"), "utf-8"), F.encode(F.lit(""), "utf-8"))
    out = rows.mapInArrow(_name, "vec_id long, d binary").withColumn("d", key).join(named, "d", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
