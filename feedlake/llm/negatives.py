"""Hard-negative mining on rotated one-bit codes with stored alignments.

Vectors are quantised to whole numbers and dealt into blocks. A block stores, for each row,
the signs of its randomly rotated vector as bits, how well the vector aligns with its code
(the length of its projection on the code's unit vector) and the length of what is left.
The product with a query splits along the code: the part along it is estimated by population
counts over the query's bit planes, the rest is bounded by Cauchy and Schwarz. That gives
each row an interval which surely holds its score. The rows with the best estimates are scored
first; rows whose interval does not reach them are skipped, and all others are scored in
whole numbers, so the result is exact.

Two searches follow each other: the best rows of an anchor's own label, then, for each of
these positives, the best rows of other labels within a band under its score.
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
POSITIVES = 5
NEGATIVES = 5
# The band of a negative's score, in percent of its positive's.
LOW_PERCENT, HIGH_PERCENT = 80, 100
ANCHOR_STEP = 100
# Components of a block of rows, and of a chunk of queries: 4 MB of whole numbers each.
BLOCK_COMPONENTS = 1 << 19
# Bit planes of a query.
PLANES = 6
ROUNDS = 2
SEED = 20_011
# What rounding in double precision may add to an interval, for vectors of length 1.
SLACK = 1e-9


def rotated(x: np.ndarray) -> np.ndarray:
    """x turned by a fixed rotation: random signs and a Hadamard transform, twice, padded to
    a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(SEED)
    for _ in range(ROUNDS):
        y = y * rng.choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            pairs = y.reshape(len(y), -1, 2, step)
            y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
            y = y.reshape(len(x), width)
            step *= 2
        y /= np.sqrt(width)
    return y


def _bits(mask: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(mask, axis=1, bitorder="little")
    words = np.zeros((len(mask), -(-max(1, packed.shape[1]) // 8) * 8), np.uint8)
    words[:, : packed.shape[1]] = packed
    return words.view("<u8")


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, alignment, length of the rest) of each row."""
    y = rotated(x.astype(float))
    alignment = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
    rest = np.sqrt(np.maximum((y * y).sum(axis=1) - alignment**2, 0.0))
    return _bits(y >= 0), alignment, rest


class Query:
    """A query vector, rotated and cut into bit planes."""

    def __init__(self, x: np.ndarray):
        self.x = x
        z = rotated(x[None].astype(float))[0]
        self.width, self.length = len(z), float(np.sqrt(z @ z))
        top = (1 << PLANES) - 1
        self.low, self.step = float(z.min()), float(z.max() - z.min()) / top or 1.0
        u = np.clip(np.rint((z - self.low) / self.step), 0, top).astype(np.int64)
        self.planes = np.concatenate([_bits(((u >> k) & 1).astype(bool)[None]) for k in range(PLANES)])
        self.sum = int(u.sum())
        off = z - (self.low + self.step * u)
        self.off = float(np.sqrt(off @ off))

    def intervals(self, words, alignment, rest) -> tuple[np.ndarray, np.ndarray]:
        """Bounds that surely hold the product with each row."""
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        weighted = np.zeros(len(words), np.int64)
        for k, plane in enumerate(self.planes):
            weighted += np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64) << k
        along = (self.low * (2 * ones - self.width) + self.step * (2 * weighted - self.sum)) / np.sqrt(self.width)
        across = np.sqrt(np.maximum(self.length**2 - np.maximum(np.abs(along) - self.off, 0.0) ** 2, 0.0))
        margin = alignment * self.off + rest * across + SLACK * (alignment + rest) * self.length
        return alignment * along - margin, alignment * along + margin


def products(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """rows @ x in whole numbers; raises where a product does not fit a long."""
    size = np.sqrt((rows.astype(float) ** 2).sum(axis=1).max(initial=0.0) * (x.astype(float) ** 2).sum())
    if size < 2**62:
        return rows @ x
    exact = [sum(a * b for a, b in zip(r, x.tolist())) for r in rows.tolist()]
    if any(not -(2**63) <= s < 2**63 for s in exact):
        raise OverflowError("a score does not fit a long")
    return np.array(exact, np.int64)


def _best(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the places at come first by score, then by id."""
    return np.lexsort((ids[at], -scores))[:k]


def surviving(query: Query, rows, words, alignment, rest, k: int) -> np.ndarray:
    """Places of the rows whose interval reaches the k-th best score that is sure: that of the
    k rows with the best estimates."""
    if len(rows) <= k:
        return np.arange(len(rows))
    low, high = query.intervals(words, alignment, rest)
    likely = np.argpartition(-(low + high), k - 1)[:k]
    return np.flatnonzero(high >= products(rows[likely], query.x).min())


class Block:
    """A block of rows, as its table row holds them."""

    def __init__(self, t: pa.Table):
        def get(c, kind):
            return np.frombuffer(t.column(c)[0].as_py(), kind)

        self.ids, self.labels, self.rows = get("ids", "<i8"), get("labels", "<i8"), get("rows", "<i8")
        n = len(self.ids)
        self.q = get("q", "<i8").reshape(n, t.column("dim")[0].as_py())
        self.words = get("words", "<u8").reshape(n, -1)
        self.alignment, self.rest = get("alignment", "<f8"), get("rest", "<f8")

    def same(self, query: Query, row: int, label: int, k: int):
        """(place, score) of the k best other rows of the label."""
        at = np.flatnonzero((self.labels == label) & (self.rows != row))
        at = at[surviving(query, self.q[at], self.words[at], self.alignment[at], self.rest[at], k)]
        scores = products(self.q[at], query.x)
        first = _best(at, scores, self.ids, k)
        return at[first], scores[first]

    def band(self, query: Query, label: int, positives: list[int], k: int):
        """For each score in positives the (place, score) of the k best rows of other labels
        within its band."""
        other = np.flatnonzero(self.labels != label)
        low, high = query.intervals(self.words[other], self.alignment[other], self.rest[other])
        open_ = np.zeros(len(other), bool)
        for p in positives:
            # Whole-number bounds of the band, in doubles a little wide.
            floor, ceiling = LOW_PERCENT * p / 100, HIGH_PERCENT * p / 100
            wide = SLACK * abs(p)
            may = np.flatnonzero((high >= floor - wide) & (low <= ceiling + wide))
            # The likeliest rows are scored first: k of them inside the band set a mark.
            likely = np.minimum((low + high)[may] / 2, ceiling)
            likely = may[np.argsort(-likely, kind="stable")[: 4 * k]]
            held = np.sort(products(self.q[other[likely]], query.x))
            held = held[(held >= -(-LOW_PERCENT * p // 100)) & (held <= HIGH_PERCENT * p // 100)]
            if len(held) >= k:
                may = may[high[may] >= held[-k]]
            open_[may] = True
        at = other[open_]
        scores = products(self.q[at], query.x)
        out = []
        for p in positives:
            inside = (scores >= -(-LOW_PERCENT * p // 100)) & (scores <= HIGH_PERCENT * p // 100)
            held = scores[inside]
            first = _best(at[inside], held, self.ids, k)
            out.append((at[inside][first], held[first]))
        return out


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _matrix(values: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = values.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype("<i8").reshape(rows, -1)


def _dealt(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """rows dealt by hash into parts of about BLOCK_COMPONENTS components, and how many."""
    total = rows.agg(F.sum(F.col("dim").cast("long") + 1)).first()[0] or 0
    parts = max(1, -(-total // BLOCK_COMPONENTS))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(parts))), parts


def index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The blocks of all rows, written, and into how many parts each length is dealt."""
    dealt, parts = _dealt(rows, "part")

    def to_block(t: pa.Table) -> pa.Table:
        q = _matrix(t.column("q"), t.num_rows)
        words, alignment, rest = codes(q)
        longs = {c: _binary(t.column(k).to_numpy().astype("<i8")) for c, k in (("ids", "id"), ("labels", "label"), ("rows", "row"))}
        return pa.table({
            "dim": t.column("dim")[:1], "part": t.column("part")[:1], "q": _binary(q), **longs,
            "words": _binary(words), "alignment": _binary(alignment), "rest": _binary(rest),
        })

    blocks = dealt.groupBy("dim", "part").applyInArrow(
        to_block,
        "dim int, part long, q binary, ids binary, labels binary, rows binary, words binary, alignment binary, rest binary",
    )
    return stage(blocks, "code-blocks"), parts


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _search(asked: DataFrame, blocks: DataFrame, parts: int, find, schema: str) -> DataFrame:
    """find(query row, block) for every query and block of its length: each chunk of
    queries meets each block in a task of its own, and sends on its best rows only."""
    chunked, chunks = _dealt(asked, "chunk")
    key = ("dim", "part", "chunk")
    left = chunked.withColumn("part", _numbers(parts))
    right = blocks.withColumn("chunk", _numbers(chunks))
    names = [f.split()[0] for f in schema.split(", ")]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            block = Block(b)
            for q in a.to_pylist():
                out += find(q, Query(np.array(q["q"], np.int64)), block)
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(names)})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)


def mine(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Every row that the condition anchors (on id and label) selects gets its best other rows of
    the same label, and for each of these the best rows of other labels whose score lies in
    the band of LOW_PERCENT to HIGH_PERCENT of the positive's; higher scores come first, ties by smaller id.

    Rows without an id, a label or a vector, or with a null or non-finite component, take
    no part. Vectors of another length than the anchor's have no score. A repeated row is a
    row of its own, as anchor and as candidate. An anchor without positives, or a positive
    without rows in its band, gives no row; a band under a negative score is empty. An empty
    table gives an empty result; other columns are not read. Vectors may be of any length and
    size; a score beyond a long raises. Every anchor meets every block, so the work
    grows with anchors times rows; a label that holds most rows is spread over all blocks.
    """
    rows = vectors.select(
        column(vectors, id_col).cast("long").alias("id"),
        column(vectors, label_col).cast("long").alias("label"),
        quantised(column(vectors, vector_col), SCALE).alias("q"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL")
    rows = stage(
        rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("q")), "quantised"
    )
    blocks, parts = index(rows)
    asked = rows.where(anchors)

    def own_label(q: dict, query: Query, block: Block) -> list[tuple]:
        at, scores = block.same(query, q["row"], q["label"], positives)
        return [
            (q["row"], r, i, s)
            for r, i, s in zip(block.rows[at].tolist(), block.ids[at].tolist(), scores.tolist())
        ]

    found = _search(asked, blocks, parts, own_label, "anchor long, positive_row long, positive_id long, score long")
    order = W.partitionBy("anchor").orderBy(F.col("score").desc(), "positive_id", "positive_row")
    best = stage(
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives"
    )

    # At most `positives` rows an anchor meet in one list.
    lists = best.groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("place", "score"))).alias("wanted")
    )

    def other_labels(q: dict, query: Query, block: Block) -> list[tuple]:
        wanted = q["wanted"]
        got = block.band(query, q["label"], [w["score"] for w in wanted], negatives)
        return [
            (q["row"], w["place"], i, s)
            for w, (at, scores) in zip(wanted, got)
            for i, s in zip(block.ids[at].tolist(), scores.tolist())
        ]

    found = _search(
        asked.join(lists, "row"), blocks, parts, other_labels, "anchor long, place long, negative_id long, negative_score long"
    )
    order = W.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = best.select("anchor", F.col("place").cast("long").alias("place"), "positive_id", F.col("score").alias("positive_score"))
    ids = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        ranked.join(pairs, ["anchor", "place"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """The embeddings with the labels the contract gives them."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))


ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id))::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND {LOW_PERCENT} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH_PERCENT} * p.score
  WHERE p.n <= {POSITIVES})
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {NEGATIVES}
"""
