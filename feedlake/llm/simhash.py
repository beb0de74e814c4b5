"""Near-duplicate texts by SimHash: an exact comparison of fingerprints in tiles.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
Distinct fingerprints are dealt to tiles that are boxes in the space of the population
counts of the four 16-bit quarters. Two fingerprints that differ in d bits have counts
that differ by d at most in sum, so tile pairs, and runs of equal counts inside a pair,
whose counts are further apart than the radius are skipped; all others are compared
with exclusive-or and bit counts. Nothing is sampled, capped or left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column, components, fresh, local_roots, map_rows
from feedlake.staging import stage

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 32_768
# Elements of one comparison matrix, and links held before they are reduced to stars.
MATRIX_CELLS = 1 << 21
HELD_LINKS = 1 << 21
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed long; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle_words + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        spans = zip(first[at : at + HASH_CHUNK], last[at : at + HASH_CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the fingerprint of its text column as a long column called name."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column(at)], pa.int64())
            names = [*batch.schema.names, "n0"]
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=names)

    return map_rows(docs, run, (name, "long"))


def quarter_counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(prints).view("<u2").reshape(-1, 4)).astype(np.int16)


def _boxes(counts: np.ndarray, sizes: np.ndarray, tile_rows: int) -> np.ndarray:
    """Box number of every count vector: boxes are halved along their widest side until full tiles fit."""
    box = np.zeros(len(sizes), np.int64)
    todo, made = [np.arange(len(sizes))], 0
    while todo:
        rows = todo.pop()
        wide = np.ptp(counts[rows], axis=0)
        if sizes[rows].sum() <= tile_rows or wide.max() == 0:
            box[rows] = made
            made += 1
            continue
        rows = rows[np.argsort(counts[rows, wide.argmax()], kind="stable")]
        side = counts[rows, wide.argmax()]
        total = np.cumsum(sizes[rows])
        cut = np.searchsorted(total, total[-1] / 2, side="right")
        value = side[min(cut, len(rows) - 1)]
        below = np.searchsorted(side, value)
        if below == 0:
            below = np.searchsorted(side, value, side="right")
        todo += [rows[:below], rows[below:]]
    return box


def _near_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int):
    """Star links between fingerprints of two tiles that differ in up to radius bits."""
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)

    def runs(x):
        counts = quarter_counts(x)
        order = np.lexsort(counts.T)
        counts = counts[order]
        starts = np.flatnonzero(np.r_[True, (counts[1:] != counts[:-1]).any(axis=1)])
        return order, counts[starts], np.diff(np.r_[starts, len(x)]), starts

    order_a, kinds_a, sizes_a, starts_a = runs(a)
    order_b, kinds_b, sizes_b, _ = (order_a, kinds_a, sizes_a, 0) if same else runs(b)
    sorted_a, sorted_b = a[order_a], b[order_b]
    held_l, held_r, held = [], [], 0

    def reduce():
        nonlocal held_l, held_r, held
        roots = local_roots(len(nodes), np.concatenate(held_l), np.concatenate(held_r))
        ends = np.flatnonzero(roots != np.arange(len(nodes)))
        held_l, held_r, held = [ends], [roots[ends]], 0
        return ends, roots[ends]

    for k in range(len(kinds_a)):
        near = np.abs(kinds_b - kinds_a[k]).sum(axis=1) <= radius
        if same:
            near[:k] = False
        picked = np.flatnonzero(np.repeat(near, sizes_b))
        if not len(picked):
            continue
        others = sorted_b[picked]
        step = max(1, MATRIX_CELLS // len(others))
        for at in range(starts_a[k], starts_a[k] + sizes_a[k], step):
            rows = sorted_a[at : min(at + step, starts_a[k] + sizes_a[k])]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ others[None, :]) <= radius)
            held_l.append(order_a[at + i])
            held_r.append(order_b[picked[j]] + shift)
            held += len(i)
            if held > HELD_LINKS:
                reduce()
    if not held_l:
        return nodes[:0], nodes[:0]
    ends, roots = reduce()
    return nodes[ends], nodes[roots]


def near_links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links between near fingerprints: (left, right) longs that connect what is connected.

    prints has one long column of distinct values; it is read twice, so pass a written
    table. Every pair within the radius is found; from each tile pair come star links
    that join the same values as the pairs found there, not the pairs themselves.
    The driver sees how many values share each of at most 17^4 count vectors, and a box
    of eight small numbers per tile.
    """
    spark = prints.sparkSession
    name = prints.columns[0]
    quarters = [
        F.bit_count(F.shiftrightunsigned(F.col(name), 16 * i).bitwiseAND(F.lit(0xFFFF)))
        for i in range(4)
    ]
    code = sum((q.cast("long") * 17**i for i, q in enumerate(quarters)), F.lit(0).cast("long"))
    coded = prints.select(F.col(name).alias("fp"), code.alias("code"))
    found = coded.groupBy("code").count().toPandas().sort_values("code")
    codes, sizes = found["code"].to_numpy(np.int64), found["count"].to_numpy(np.int64)
    counts = np.stack([codes // 17**i % 17 for i in range(4)], axis=1) if len(codes) else None
    box = _boxes(counts, sizes, tile_rows) if len(codes) else np.zeros(0, np.int64)
    # A box larger than a tile holds one count vector only; its values are dealt to several.
    first, per_code, edges = 0, {}, []
    for number in range(box.max(initial=-1) + 1):
        rows = np.flatnonzero(box == number)
        parts = -(-int(sizes[rows].sum()) // tile_rows)
        low, high = counts[rows].min(axis=0), counts[rows].max(axis=0)
        edges += [np.r_[low, high]] * parts
        per_code.update((int(codes[r]), (first, parts)) for r in rows)
        first += parts
    edges = np.array(edges, np.int16).reshape(-1, 8)

    def to_tiles(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            mixed = (fps.astype("<u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            places = [per_code[c] for c in batch.column(1).to_pylist()]
            start = np.fromiter((p[0] for p in places), np.int64, len(places))
            parts = np.fromiter((p[1] for p in places), np.int64, len(places))
            tile = start + mixed.astype(np.int64) % parts
            yield pa.RecordBatch.from_arrays([pa.array(tile), batch.column(0)], ["tile", "fp"])

    def to_binary(t: pa.Table) -> pa.Table:
        fps = np.sort(t.column("fp").to_numpy())
        return pa.table({"tile": t.column("tile")[:1], "fps": pa.array([fps.tobytes()], pa.binary())})

    tiles = (
        coded.mapInArrow(to_tiles, "tile long, fp long")
        .groupBy("tile")
        .applyInArrow(to_binary, "tile long, fps binary")
    )
    tiles = stage(tiles, "tiles")

    def partners(as_left: bool):
        def run(batches):
            for batch in batches:
                for tile, fps in zip(batch.column(0).to_pylist(), batch.column(1)):
                    low, high = edges[tile, :4], edges[tile, 4:]
                    gap = np.maximum(edges[:, :4] - high, low - edges[:, 4:])
                    near = np.flatnonzero(np.maximum(gap, 0).sum(axis=1) <= radius)
                    near = near[near >= tile] if as_left else near[near <= tile]
                    for other in near.tolist():
                        pair = [tile, other] if as_left else [other, tile]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x], pa.int64()) for x in pair]
                            + [pa.array([fps.as_py()], pa.binary())],
                            names=["a", "b", "fps"],
                        )

        return tiles.mapInArrow(run, "a long, b long, fps binary").groupBy("a", "b")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        same = left.column("a")[0] == left.column("b")[0]
        # Unsigned, as bitwise_count takes the bits of the absolute value.
        a = np.frombuffer(left.column("fps")[0].as_py(), "<u8")
        b = np.frombuffer(right.column("fps")[0].as_py(), "<u8")
        node, root = _near_links(a, b, same, radius)
        return pa.table({"left": node.view("<i8"), "right": root.view("<i8")})

    if not len(edges):
        return spark.createDataFrame([], "left long, right long")
    return partners(True).cogroup(partners(False)).applyInArrow(compare, "left long, right long")


def fingerprint_groups(
    printed: DataFrame, fp: str, radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """(fp, group) for every distinct fingerprint of a written table; group is the smallest linked one."""
    value = column(printed, fp)
    distinct = stage(printed.where(value.isNotNull()).select(value.alias("fp")).distinct(), "prints")
    linked = components(near_links(distinct, radius, tile_rows), "left", "right")
    return distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("group")
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id of the group, nulls left aside. A null text counts as
    empty; texts without words share fingerprint 0 and so one group. Repeated rows come
    out as often as they came in. An empty table gives an empty result; extra columns are
    not read.
    """
    narrow = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    printed = stage(with_fingerprint(narrow, "text", "fp").select("id", "fp"), "fingerprints")
    groups = stage(fingerprint_groups(printed, "fp", radius, tile_rows), "groups")
    # Ids are reduced to one per fingerprint before they meet their group.
    lowest = printed.groupBy("fp").agg(F.min("id").alias("low")).join(groups, "fp")
    named = lowest.groupBy("group").agg(F.min("low").alias("component_id"))
    by_print = groups.join(named, "group").select("fp", "component_id")
    return printed.join(by_print, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest id.

    Ids are compared with nulls last; among rows that repeat an id any one stays.
    """
    fp, row = fresh(docs, "simhash_fp", "simhash_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    printed = stage(with_fingerprint(numbered, text_col, fp), "printed")
    groups = fingerprint_groups(printed, fp)
    order = F.struct(column(printed, id_col).isNull(), column(printed, id_col), F.col(row))
    first = printed.groupBy(fp).agg(F.min(order).alias("first"))
    first = first.join(groups, first[fp] == groups["fp"]).groupBy("group").agg(F.min("first").alias("first"))
    keep = first.select(F.col("first")[row].alias(row))
    return printed.join(keep, row, "left_semi").select(*[column(printed, c) for c in docs.columns])
