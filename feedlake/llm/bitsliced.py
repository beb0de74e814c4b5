"""Exact top-k by inner product on a bit-sliced index.

Vectors are quantised to whole numbers and cut into blocks of rows. A block stores, for
each dimension, one bitmap of its rows per bit of the value (shifted to start at zero).
A query's score is summed for all rows of a block at once by bitmap arithmetic: for each
bit of the query's weights the slices of the dimensions that have it are added with carry-save adders,
negative weights taking the complement; the sums' slices are then added with carries.
The best rows are selected from the most significant slice of the scores downward; rows
that tie on all slices are the boundary, and of them those with the smallest ids are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.llm.common import column, quantised
from feedlake.staging import stage

SCALE = 256
TOP = 5
QUERY_STEP = 50
BLOCK_ROWS = 12_288
CHUNK_QUERIES = 1024
# Components of a block, so that longer vectors come in blocks of fewer rows, and of a chunk.
BLOCK_COMPONENTS = 64 * BLOCK_ROWS
CHUNK_COMPONENTS = 1 << 22


def _matrix(values: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = values.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(rows, -1)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).tobytes()], pa.binary())


def build(matrix: np.ndarray) -> tuple[int, np.ndarray]:
    """(lowest value, slices[dimension, bit, word]): the block's bitmaps, rows in bit order."""
    low = int(matrix.min(initial=0))
    # Unsigned, as the span of the values may pass a signed long.
    shifted = matrix.astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-len(matrix) // 64)
    slices = np.zeros((matrix.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        plane = ((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        packed = np.packbits(plane.T, axis=1, bitorder="little")
        slices[:, b, : packed.shape[1]] = packed
    return low, slices.view("<u8")


def _add_into(total: np.ndarray, part: np.ndarray, shift: int) -> None:
    """total += part << shift, slice by slice with a carry."""
    carry = np.zeros_like(total[0])
    for k in range(shift, len(total)):
        a = total[k]
        if k - shift < len(part):
            b = part[k - shift]
            both = a ^ b
            total[k], carry = both ^ carry, (a & b) | (both & carry)
        else:
            if not carry.any():
                return
            total[k], carry = a ^ carry, a & carry


def score_slices(slices: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps of the rows' sums and what they are too high by.

    Of a negative weight the complement counts: -w * u = w * (M - u) - w * M with all bits M.
    """
    dims, bits, words = slices.shape
    full = (1 << bits) - 1
    size = np.abs(weights)
    # Plain integers: the sums get as many slices as they need.
    width = max(1, (sum(size.tolist()) * full).bit_length())
    total = np.zeros((width, words), np.uint64)
    for b in range(int(size.max()).bit_length() if dims else 0):
        picked = np.flatnonzero((size >> b) & 1)
        if not len(picked):
            continue
        height = bits + len(picked).bit_length()
        one = np.zeros((height, words), np.uint64)
        two = np.zeros((height, words), np.uint64)
        for d in picked:
            add = slices[d] if weights[d] > 0 else ~slices[d]
            # Carry-save: three numbers become a sum and its carries, one place up.
            low1, low2 = one[:bits], two[:bits]
            half = low1 ^ low2
            carry = np.zeros_like(one)
            carry[1 : bits + 1] = (low1 & low2) | (half & add)
            carry[bits + 1 :] = (one[bits:-1] & two[bits:-1])
            one[bits:] ^= two[bits:]
            one[:bits] = half ^ add
            two = carry
        _add_into(total, one, b)
        _add_into(total, two, b)
    return total, sum(size[weights < 0].tolist()) * full


def select_top(total: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, boundary) bitmaps: rows among the best k, and rows that tie for the places left."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    if int(np.bitwise_count(valid).sum()) <= k:
        return valid, sure
    for plane in total[::-1]:
        high = open_ & plane
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        else:
            sure |= high
            open_ = open_ & ~plane
            if n == k:
                return sure, np.zeros_like(valid)
    return sure, open_


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(low, slices, rows, weights, skip, k) -> tuple[np.ndarray, np.ndarray]:
    """The best k rows of a block but skip (-1: none), by score and then by place, and their scores."""
    valid = np.zeros(slices.shape[2] * 64, np.uint8)
    valid[:rows] = 1
    if skip >= 0:
        valid[skip] = 0
    total, excess = score_slices(slices, weights)
    sure, boundary = select_top(total, np.packbits(valid, bitorder="little").view("<u8"), k)
    best = _rows_of(sure)
    best = np.concatenate([best, _rows_of(boundary)[: k - len(best)]])
    word, bit = best // 64, (best % 64).astype(np.uint64)
    planes = (total[:, word] >> bit) & np.uint64(1)
    sums = [sum(1 << i for i in np.flatnonzero(planes[:, j]).tolist()) for j in range(len(best))]
    base = low * sum(weights.tolist()) - excess
    scores = [s + base for s in sums]
    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError("a score among the best does not fit a long")
    return best, np.array(scores, np.int64)


def index(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> tuple:
    """(rows, blocks, parts): the quantised rows and their bit-sliced blocks, both written,
    and how many blocks there are of each length.

    A block holds rows of one length, about BLOCK_COMPONENTS components as a hash deals the
    rows out, by ascending id.
    """
    rows = vectors.select(
        column(vectors, id_col).cast("long").alias("id"),
        quantised(column(vectors, vector_col), scale).alias("q"),
    ).where("id IS NOT NULL AND q IS NOT NULL")
    rows = stage(
        rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("q")), "quantised"
    )
    components = rows.agg(F.sum(F.greatest("dim", F.lit(64)).cast("long"))).first()[0] or 0
    parts = max(1, -(-components // BLOCK_COMPONENTS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))

    def to_block(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("row").to_numpy(), t.column("id").to_numpy()))
        t = t.take(pa.array(order))
        low, slices = build(_matrix(t.column("q"), t.num_rows))
        return pa.table({
            "dim": t.column("dim")[:1],
            "part": t.column("part")[:1],
            "low": pa.array([low], pa.int64()),
            "slices": _binary(slices),
            "ids": _binary(t.column("id").to_numpy()),
            "rows": _binary(t.column("row").to_numpy()),
        })

    blocks = dealt.groupBy("dim", "part").applyInArrow(
        to_block, "dim int, part long, low long, slices binary, ids binary, rows binary"
    )
    return rows, stage(blocks, "blocks"), parts


def search(rows: DataFrame, blocks: DataFrame, parts: int, queries: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that the condition queries selects.

    Queries go in chunks; every chunk meets every block of its length once, in a task of
    its own, and sends on its k best per query. Rows of other lengths have no score.
    """
    asked = rows.where(queries)
    n, components = asked.agg(F.count("*"), F.sum(F.col("dim").cast("long"))).first()
    chunks = max(1, -(-n // CHUNK_QUERIES), -(-(components or 0) // CHUNK_COMPONENTS))
    chunked = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))

    def to_chunk(t: pa.Table) -> pa.Table:
        q = _matrix(t.column("q"), t.num_rows).astype("<i8")
        return pa.table({
            "dim": t.column("dim")[:1],
            "chunk": t.column("chunk")[:1],
            "q": _binary(q),
            "ids": _binary(t.column("id").to_numpy()),
            "rows": _binary(t.column("row").to_numpy()),
        })

    packed = chunked.groupBy("dim", "chunk").applyInArrow(
        to_chunk, "dim int, chunk long, q binary, ids binary, rows binary"
    )
    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = packed.withColumn("part", numbers(parts))
    right = blocks.withColumn("chunk", numbers(chunks))
    key = ("dim", "part", "chunk")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {c: [] for c in ("query_row", "query_id", "vec_id", "score")}
        if a.num_rows and b.num_rows:
            def get(t, c):
                return np.frombuffer(t.column(c)[0].as_py(), "<i8")

            ids, block_rows = get(b, "ids"), get(b, "rows")
            dim, low = b.column("dim")[0].as_py(), b.column("low")[0].as_py()
            words = -(-len(ids) // 64)
            slices = np.frombuffer(b.column("slices")[0].as_py(), "<u8")
            slices = slices.reshape(dim, -1, words) if dim else np.zeros((0, 1, words), np.uint64)
            at = {r: i for i, r in enumerate(block_rows.tolist())}
            asked_ids = get(a, "ids").tolist()
            weights = get(a, "q").reshape(len(asked_ids), dim)
            for w, query, row in zip(weights, asked_ids, get(a, "rows").tolist()):
                best, scores = top_rows(low, slices, len(ids), w, at.get(row, -1), k)
                out["query_row"] += [row] * len(best)
                out["query_id"] += [query] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        score, "query_row long, query_id long, vec_id long, score long"
    )
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    step: int = QUERY_STEP,
    k: int = TOP,
) -> DataFrame:
    """The k best other rows for every row whose id is divisible by step, over all rows.

    Vectors that are null, hold null or non-finite components, or have no id, take no part;
    all others do, whatever their length and size. Vectors of different lengths have
    no score; empty ones score 0 with each other. A component that no long can hold after scaling
    raises, and so does a score beyond a long among the best. A repeated row is a row of its own:
    it is a query and a candidate as often as it occurs, and only the query's own row is
    left out. An empty table gives an empty result; extra columns are not read.
    """
    rows, blocks, parts = index(vectors, id_col, vector_col)
    return search(rows, blocks, parts, F.col("id") % step == 0, k)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
