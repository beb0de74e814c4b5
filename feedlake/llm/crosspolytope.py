"""Near-duplicate vectors by cross-polytope hashing, with verified pairs.

Equal vectors of a label are one class. Each class vector is rotated by three rounds of
random signs and a fast Hadamard transform; its hash is the axis, with sign, that the
rotated vector lies nearest to. A table joins a few such hashes; a vector goes to its own
bucket and to the next nearest ones (multiprobe). All vectors that meet in a bucket are
compared, and a pair counts where its cosine, in double precision, reaches the threshold.

Two vectors that meet in several buckets count in the one with the smallest key, so links
are counted without being written out. Buckets of any size are compared in full: large
ones are split into tiles, and every pair of tiles is a unit of work of its own. What
leaves a task is a count per class and the links of a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column, components, local_roots
from feedlake.staging import stage

THRESHOLD = 0.98
TABLES = 10
PROBES = 3
# Hashes per table are chosen so that about so many unlike vectors meet in a bucket.
BUCKET_VECTORS = 32
MAX_HASHES = 4
# A bucket is split into tiles of so many bytes of vectors and keys. Each tile meets each other
# one, so a bucket's rows are sent once a tile: few large tiles send less, small ones spread more.
TILE_BYTES = 4 << 20
# Products are worked out for so many rows against as many.
PRODUCT_ROWS = 1024
SMALL_CELL = 48
SEED = 42
# Pairs whose buckets are compared at once.
PAIR_CHUNK = 1 << 14


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; first scaled by their largest component, so squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_codes(x: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket codes of unit rows: [row, table * probe], own bucket first, then the nearest others."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    out = []
    rng = np.random.default_rng(SEED)
    for table in range(tables):
        axes, losses = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(probes, width)]
            near = np.take_along_axis(y, order, axis=1)
            axes.append(2 * order + (near < 0))
            losses.append(np.abs(near[:, :1]) - np.abs(near))
        # One hash at a time is exchanged for its next best axis, cheapest first.
        own = np.stack([a[:, 0] for a in axes], axis=1)
        options, cost = [own], [np.zeros(n)]
        for h in range(hashes):
            for p in range(1, axes[h].shape[1]):
                other = own.copy()
                other[:, h] = axes[h][:, p]
                options.append(other)
                cost.append(losses[h][:, p])
        best = np.argsort(np.stack(cost, axis=1), axis=1, kind="stable")[:, :probes]
        taken = np.take_along_axis(np.stack(options, axis=1), best[:, :, None], axis=1)
        code = np.full(taken.shape[:2], table, np.int64)
        for h in range(hashes):
            code = code * (2 * width) + taken[:, :, h]
        out.append(code)
    return np.concatenate(out, axis=1)


def bucket_keys(codes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Codes and the rows' groups mixed to longs. A clash only adds pairs to compare."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= groups.astype(np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))).view(np.int64)


def _matrix(values: pa.Array, rows: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _counted_here(key: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs' smallest shared bucket is the one they were found in."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIR_CHUNK):
        a, b = keys[i[at : at + PAIR_CHUNK]], keys[j[at : at + PAIR_CHUNK]]
        shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
        low = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1)
        out[at : at + PAIR_CHUNK] = low == key[at : at + PAIR_CHUNK]
    return out


class _Links:
    """Links of some cells: counts per class, and a forest of what is connected."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.left, self.right = [], []

    def add(self, key, cls, many, keys, i, j) -> None:
        if not len(i):
            return
        self.left.append(cls[i])
        self.right.append(cls[j])
        here = _counted_here(key, keys, i, j)
        for a, b in ((i[here], j[here]), (j[here], i[here])):
            own, at = np.unique(cls[a], return_inverse=True)
            sums = np.bincount(at, weights=many[b]).astype(np.int64)
            for c, n in zip(own.tolist(), sums.tolist()):
                self.counts[c] = self.counts.get(c, 0) + n
        if sum(map(len, self.left)) > 1 << 20:
            self.reduce()

    def reduce(self) -> None:
        nodes, at = np.unique(np.concatenate([*self.left, *self.right]), return_inverse=True)
        half = len(at) // 2
        roots = local_roots(len(nodes), at[:half], at[half:])
        ends = np.flatnonzero(roots != np.arange(len(nodes)))
        self.left, self.right = [nodes[ends]], [nodes[roots[ends]]]

    def batch(self) -> pa.RecordBatch:
        if self.left:
            self.reduce()
        left = np.concatenate([np.zeros(0, np.int64), *self.left])
        right = np.concatenate([np.zeros(0, np.int64), *self.right])
        counted = np.fromiter(self.counts, np.int64, len(self.counts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[left, counted]),
                pa.array(np.r_[right, counted]),
                pa.array(np.r_[np.zeros(len(left), np.int64), np.fromiter(self.counts.values(), np.int64, len(counted))]),
            ],
            names=["cls", "other", "links"],
        )


def _compare(threshold: float):
    """Compares the rows of each cell; rows come sorted by cell (key, a, b)."""

    def cells(links, cell, key, side, cls, many, x, keys):
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(cell)])
        # Cells of a few rows: neighbours at each distance, all cells at once.
        small = np.repeat(sizes <= SMALL_CELL, sizes)
        last = np.repeat(starts + sizes, sizes)
        for d in range(1, int(sizes[sizes <= SMALL_CELL].max(initial=1))):
            i = np.flatnonzero(small & (np.arange(len(cell)) + d < last))
            j = i + d
            i, j = _open(cell, side, i, j)
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            links.add(key[i[near]], cls, many, keys, i[near], j[near])
        for s, n in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL]):
            own = np.arange(s, s + n)
            same = cell[s, 1] == cell[s, 2]
            left, right = (own, own) if same else (own[side[own] == t] for t in cell[s, 1:])
            for at in range(0, len(left), PRODUCT_ROWS):
                a = left[at : at + PRODUCT_ROWS]
                for to in range(at if same else 0, len(right), PRODUCT_ROWS):
                    b = right[to : to + PRODUCT_ROWS]
                    near = x[a] @ x[b].T >= threshold
                    if same and to == at:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    links.add(key[a[i]], cls, many, keys, a[i], b[j])

    def _open(cell, side, i, j):
        """Pairs of a cell: across its two tiles, or any in a cell of one tile."""
        keep = (cell[i, 1] == cell[i, 2]) | (side[i] != side[j])
        return i[keep], j[keep]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            cell = np.stack([held.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
            # The last cell may go on in the next batch.
            end = int(np.flatnonzero((cell != cell[-1]).any(axis=1)).max(initial=-1)) + 1
            if end:
                yield done(held.slice(0, end))
            held = held.slice(end)
        if held is not None:
            yield done(held)

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        links = _Links()
        dims = pa.compute.list_value_length(rows.column("v")).to_numpy()
        for dim in np.unique(dims):
            own = rows if (dims == dim).all() else rows.filter(pa.array(dims == dim))
            cell = np.stack([own.column(c).to_numpy() for c in ("key", "a", "b")], axis=1)
            cells(
                links,
                cell,
                cell[:, 0],
                own.column("side").to_numpy(),
                own.column("cls").to_numpy(),
                own.column("many").to_numpy(),
                unit(_matrix(own.column("v"), own.num_rows)),
                _matrix_long(own.column("keys"), own.num_rows),
            )
        return links.batch()

    return run


def _matrix_long(values: pa.Array, rows: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def class_links(classes: DataFrame, threshold: float = THRESHOLD, hashes: int | None = None) -> DataFrame:
    """(cls, other, links) from a written table (cls, label, v, many).

    Rows with cls = other carry link counts, each counted once, many copies as many links;
    the others are links that connect what is connected.
    """
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    if hashes is None:
        width = 2 << max(1, (dim - 1).bit_length())
        hashes = math.ceil(math.log(max(n / BUCKET_VECTORS, 1.0)) / math.log(width))
        hashes = min(max(hashes, 1), MAX_HASHES)

    def hash_rows(batches):
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                codes = bucket_codes(unit(_matrix(own.column(2), own.num_rows)), hashes)
                groups = own.column(1).to_numpy().astype(np.int64) * 4099 + int(d)
                keys = np.sort(bucket_keys(codes, groups), axis=1)
                flat = pa.array(keys.ravel())
                offsets = pa.array(np.arange(own.num_rows + 1, dtype=np.int32) * keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), own.column(3), pa.ListArray.from_arrays(offsets, flat)],
                    names=["cls", "v", "many", "keys"],
                )

    hashed = classes.select("cls", F.xxhash64("label").alias("label"), "v", "many").mapInArrow(
        hash_rows, "cls long, v array<double>, many long, keys array<long>"
    )
    hashed = stage(hashed, "hashed")
    entries = hashed.select("cls", F.explode(F.array_distinct("keys")).alias("key"))
    # Buckets with one vector have nothing to compare and are not moved.
    met = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tile_rows = max(1, TILE_BYTES // (8 * (dim + TABLES * PROBES)))
    tiles = F.ceil(F.col("n") / tile_rows)
    side = F.pmod(F.xxhash64("cls", F.lit(SEED)), F.col("tiles"))
    cells = (
        entries.join(met, "key")
        .withColumn("tiles", tiles.cast("long"))
        .withColumn("side", side)
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("key", "cls", "side", F.least("side", "with").alias("a"), F.greatest("side", "with").alias("b"))
    )
    rows = (
        cells.join(hashed, "cls")
        .repartition("key", "a", "b")
        .sortWithinPartitions("key", "a", "b")
        .select("key", "a", "b", "side", "cls", "many", "v", "keys")
    )
    return rows.mapInArrow(_compare(threshold), "cls long, other long, links long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    hashes: int | None = None,
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal, and their
    cosine reaches the threshold. Null, empty and zero vectors and those with null or
    non-finite components link with nothing. Repeated rows are vectors of their own. The
    smallest id leaves nulls aside. An empty table gives an empty result; extra columns are
    not read.
    """
    x = column(vectors, vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    sound = finite & F.exists(x, lambda v: v != 0) & column(vectors, label_col).isNotNull()
    rows = stage(
        vectors.select(
            column(vectors, id_col).alias("id"),
            column(vectors, label_col).alias("label"),
            F.when(sound, x).alias("v"),
        ),
        "vectors",
    )
    classes = (
        rows.where("v IS NOT NULL")
        .groupBy("label", "v")
        .agg(F.count("*").alias("many"), F.min("id").alias("low"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    classes = stage(classes, "classes")
    links = stage(class_links(classes, threshold, hashes), "links")
    counts = links.where("cls = other").groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(links.where("cls <> other"), "cls", "other")
    named = (
        classes.join(roots, classes["cls"] == roots["node"], "left")
        .select("label", "v", "cls", "many", "low", F.coalesce("root", "cls").alias("root"))
        .join(counts, "cls", "left")
    )
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lowest, "root").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), "component"
    )
    known = rows.join(named, ["label", "v"], "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component"))
    return known.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
