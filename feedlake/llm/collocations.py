"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix and holds an associative counter of the words that follow it,
with an own entry, the empty word, for "nothing of interest follows". Tasks build
partial stripes from their texts; stripes of one prefix are merged element by element. The merged
structure answers everything: its entries count the extensions of a prefix, the sum of its
entries counts the prefix itself, and the largest entry over a phrase says what subsumes it.

Stripes are built twice: over prefixes of one word, and over prefixes of three words, there only
where each two neighbours are a phrase that is frequent enough, as any part of a frequent
phrase is. These pairs are looked up in a bitmap of their hashes, which never
misses one; a pair that is in the bitmap by chance is counted and then falls below the mark. A stripe
travels in SALTS parts, parted by the next word, so that a very common prefix is
merged by many tasks.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.llm.common import column
from feedlake.staging import broadcast_if_small, stage

MIN_COUNT = 30
SCALE = 2_000_000
# Of a phrase's count, in percent: a longer candidate that reaches this subsumes it.
SUBSUMED_PERCENT = 80
TOP = 2000
NO_LANGUAGE = "und"
SALTS = 16
# Words that a task counts together, and bytes of text that it splits together.
CHUNK_WORDS = 1 << 20
CHUNK_BYTES = 4 << 20
# The bitmap of frequent pairs: bits a pair, and its bounds. Above the upper one more
# pairs share a bit, which costs work but no result.
BITS_PER_PAIR = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SEGMENT_BITS = 1 << 15
BROADCAST_PHRASES = 500_000

# A-Z become a-z, the ends of pieces become line ends, tabs become spaces.
_PLAIN = bytes.maketrans(
    (string.ascii_uppercase + ".,;:!?\x0b\x0c\r\t").encode(),
    (string.ascii_lowercase + "\n" * 9 + " ").encode(),
)


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) for w in names], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _pair_bits(lang: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each pair of words, given the hashes of language and words."""
    mixed = (left ^ (lang >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) + right
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, words of each piece, the text of each piece), pieces without words left out."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(data.to_pybytes().translate(_PLAIN) if data else b"")
    texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, plain], 0, texts.offset)
    pieces = pc.split_pattern(texts, "\n")
    of_text = pc.list_parent_indices(pieces).to_numpy()
    split = pc.split_pattern(pieces.flatten(), " ")
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    of_piece = pc.list_parent_indices(split).to_numpy()[real.to_numpy(zero_copy_only=False)]
    lengths = np.bincount(of_piece, minlength=len(of_text))
    return words.filter(real), lengths[lengths > 0], of_text[lengths > 0]


class _Chunk:
    """Words of some texts with the lengths and the languages of their pieces."""

    def __init__(self, context: int, bitmap: np.ndarray | None):
        self.context, self.bitmap = context, bitmap
        self.langs: dict[str, int] = {}
        self.words: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.of_lang: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        words, lengths, of_text = _split(texts)
        numbers = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs.to_pylist()], np.int64)
        self.words.append(words)
        self.lengths.append(lengths)
        self.of_lang.append(numbers[of_text])
        self.size += len(words)

    def stripes(self) -> pa.Table:
        """The partial stripes: (lang, prefix, salt, nexts, counts)."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        names = [b"", *coded.dictionary.cast(pa.large_binary()).to_pylist()]
        words = coded.indices.to_numpy().astype(np.int64) + 1
        lengths = np.concatenate(self.lengths)
        langs = np.repeat(np.concatenate(self.of_lang), lengths)
        n, base = len(words), len(names)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        hashes = _hashes(names)
        context = [words]
        for k in range(1, self.context + 1):
            later = np.zeros(n, np.int64)
            later[: n - k] = words[k:]
            context.append(np.where(left > k, later, 0))
        if self.bitmap is not None:
            tongues = _hashes([x.encode() for x in self.langs])
            known = np.zeros(n, bool)
            bits = _pair_bits(tongues[langs], hashes[words], hashes[context[1]], len(self.bitmap) * 8)
            known = ((self.bitmap[bits >> 3] >> (bits & 7)) & 1).astype(bool) & (context[1] > 0)
            # A prefix must be made of known pairs; a next word that is not known counts as none.
            follows = np.zeros(n, bool)
            follows[: n - 1] = known[1:]
            last = np.zeros(n, bool)
            last[: n - 2] = known[2:]
            at = np.flatnonzero(known & follows)
            context = [c[at] for c in context]
            context[3] = np.where(last[at], context[3], 0)
            langs = langs[at]
        # One number for each run of words from the left, so that equal contexts meet.
        number = langs
        for c in context:
            _, number = np.unique(number * base + c, return_inverse=True)
        _, at, counts = np.unique(number, return_index=True, return_counts=True)
        salts = (hashes >> np.uint64(40)).astype(np.int64) % SALTS
        context, langs = [c[at] for c in context], langs[at]
        salt = salts[context[-1]]
        # The numbers are in order of the prefix already; only the salts part a prefix.
        prefix_number = langs
        for c in context[:-1]:
            _, prefix_number = np.unique(prefix_number * base + c, return_inverse=True)
        key = prefix_number * SALTS + salt
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        context = [c[order] for c in context]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        table = pa.array(names, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        prefix = table.take(pa.array(context[0][begins]))
        for c in context[1:-1]:
            prefix = pc.binary_join_element_wise(prefix, table.take(pa.array(c[begins])), " ")
        offsets = pa.array(np.append(begins, len(key)).astype(np.int32))
        return pa.table({
            "lang": pa.array(list(self.langs), pa.string()).take(pa.array(langs[order][begins])),
            "prefix": prefix,
            "salt": pa.array((key[begins] % SALTS).astype(np.int32)),
            "nexts": pa.ListArray.from_arrays(offsets, table.take(pa.array(context[-1]))),
            "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
        })


STRIPES = "lang string, prefix string, salt int, nexts array<string>, counts array<long>"


def _pieces_of(batch: pa.RecordBatch):
    """Slices of a batch with about CHUNK_BYTES of text each, one text at least."""
    ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def stripes(
    docs: DataFrame,
    context: int,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    bitmap=None,
) -> DataFrame:
    """(lang, prefix, extension, n): the merged stripes over prefixes of context words, written.

    Entries with n >= min_count stand alone; those below, and the ends, share
    one row per part of a stripe, without an extension. A bitmap (a broadcast of bytes) names the pairs of words that
    prefixes may be made of.
    """
    lang = F.coalesce(column(docs, lang_col).cast("string"), F.lit(NO_LANGUAGE))
    texts = docs.select(F.coalesce(column(docs, text_col), F.lit("")).alias("text"), lang.alias("lang"))

    def partial(batches):
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        chunk = _Chunk(context, bits)
        for batch in batches:
            for some in _pieces_of(batch):
                chunk.add(some.column(0), some.column(1))
                if chunk.size >= CHUNK_WORDS:
                    yield from chunk.stripes().to_batches(max_chunksize=8192)
                    chunk = _Chunk(context, bits)
        if chunk.size:
            yield from chunk.stripes().to_batches(max_chunksize=8192)

    parts = texts.mapInArrow(partial, STRIPES).repartition("lang", "prefix", "salt")
    entries = parts.select("lang", "prefix", "salt", F.inline(F.arrays_zip("nexts", "counts")).alias("next", "m"))
    # Element by element, where the parts of a stripe already are: no further shuffle.
    merged = entries.groupBy("lang", "prefix", "salt", "next").agg(F.sum("m").alias("m"))
    extension = F.when((F.col("next") != "") & (F.col("m") >= min_count), F.col("next"))
    kept = merged.groupBy("lang", "prefix", "salt", extension.alias("extension")).agg(F.sum("m").alias("n"))
    return stage(kept.drop("salt"), "stripes")


def _totals(merged: DataFrame) -> DataFrame:
    """(lang, phrase, f): the prefixes themselves."""
    return merged.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("f"))


def _extensions(merged: DataFrame) -> DataFrame:
    return merged.where("extension IS NOT NULL").select(
        "lang", F.concat_ws(" ", "prefix", "extension").alias("phrase"), F.col("n").alias("f")
    )


def pair_bitmap(pairs: DataFrame, count: int) -> bytes:
    """The bitmap of the pairs (lang, phrase), built in segments."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, count) * BITS_PER_PAIR - 1).bit_length()))

    def places(batches):
        for batch in batches:
            tongue = _hashes([x.encode() for x in batch.column(0).to_pylist()])
            words = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            at = _pair_bits(tongue, _hashes([w[0] for w in words]), _hashes([w[1] for w in words]), bits)
            yield pa.RecordBatch.from_pydict({"segment": at // SEGMENT_BITS, "bit": at % SEGMENT_BITS})

    def pack(t: pa.Table) -> pa.Table:
        mask = np.zeros(SEGMENT_BITS, bool)
        mask[t.column("bit").to_numpy()] = True
        packed = np.packbits(mask, bitorder="little").tobytes()
        return pa.table({"segment": t.column("segment")[:1], "bits": pa.array([packed], pa.binary())})

    at = pairs.select("lang", "phrase").mapInArrow(places, "segment long, bit long").distinct()
    out = np.zeros(bits // 8, np.uint8)
    step = SEGMENT_BITS // 8
    # MOST_BITS / 8 bytes at most come to the driver.
    for row in at.groupBy("segment").applyInArrow(pack, "segment long, bits binary").toLocalIterator():
        out[row["segment"] * step : (row["segment"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def phrase_counts(
    docs: DataFrame, text_col: str, lang_col: str, min_count: int
) -> tuple[DataFrame, DataFrame]:
    """(frequent, sizes): (lang, phrase, words, f) of every phrase of up to four words with
    f >= min_count, written, and (lang, n), all word occurrences of each language."""
    single = stripes(docs, 1, text_col, lang_col, min_count)
    pairs = stage(_extensions(single), "pairs")
    bitmap = pair_bitmap(pairs, pairs.count())
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)
    triple = stripes(docs, 3, text_col, lang_col, min_count, bitmap)
    counted = [(1, _totals(single)), (2, pairs), (3, _totals(triple)), (4, _extensions(triple))]
    out = None
    for words, phrases in counted:
        some = phrases.where(F.col("f") >= min_count).withColumn("words", F.lit(words))
        out = some if out is None else out.unionByName(some)
    return stage(out, "phrases"), single.groupBy("lang").agg(F.sum("n").alias("n"))


def _subsumed(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count among the one word longer phrases around a phrase.

    A longer phrase is never more frequent than what lies between, so one word is enough.
    """
    longer = frequent.where(F.col("words") > 2).select("lang", F.split("phrase", " ").alias("w"), "f")
    n = F.size("w")
    inner = F.array(
        F.array_join(F.slice("w", F.lit(1), n - 1), " "), F.array_join(F.slice("w", F.lit(2), n - 1), " ")
    )
    return (
        longer.select("lang", F.explode(inner).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("most"))
    )


def _score(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts) in exact decimals."""
    wide = "decimal(38,0)"
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a.cast("decimal(25,0)"), parts.cast(wide))


def phrases(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
) -> DataFrame:
    """Each language's best phrases: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), split into pieces at . , ; : ! ? and line ends, and into words
    at spaces and tabs. Candidates are the phrases of 2 to 4 words that occur at least min_count times in
    pieces of the language (null: und). A candidate's lowest-scoring cut counts, ties go to the
    shortest first part; it is dropped where a longer candidate around it has at least
    SUBSUMED_PERCENT of its count. The best are taken by score, count and phrase in byte order.

    Null and empty texts have no words. Repeated rows count as often as they occur. An empty table
    gives an empty result; other columns are not read. Texts are read whole, whatever their
    length: a task counts CHUNK_WORDS words, or one longer text, at a time and sends
    partial stripes on, which are merged by prefix and part.
    """
    frequent, sizes = phrase_counts(docs, text_col, lang_col, min_count)
    candidates = frequent.where(F.col("words") > 1).withColumnRenamed("f", "a")
    kept = candidates.join(_subsumed(frequent), ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * SUBSUMED_PERCENT)
    )
    w = F.split("phrase", " ")
    cut = kept.select("lang", "phrase", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    sides = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    known = broadcast_if_small(frequent.select("lang", "phrase", "f"), BROADCAST_PHRASES)
    for side, count in (("first", "l"), ("rest", "r")):
        counts = known.withColumnsRenamed({"phrase": side, "f": count})
        sides = sides.join(counts, ["lang", side])
    scored = sides.withColumn("score", _score(F.col("a"), F.col("l").cast("decimal(25,0)") + F.col("r")))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    return (
        worst.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .join(F.broadcast(sizes), "lang")
        .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )


def _oracle() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[s + 1 : s + {k}], ' ') AS phrase "
        f"FROM (SELECT lang, w, unnest(range(len(w) - {k - 1})) AS s FROM p WHERE len(w) >= {k})"
        for k in range(1, 5)
    )
    return f"""
WITH t AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, [x FOR x IN string_split_regex(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM t),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
q AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= {MIN_COUNT}),
z AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
s AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, unnest([array_to_string(w[s + 1 : s + m], ' ') FOR s IN range(k - m + 1)]) AS phrase, f
    FROM q, (VALUES (2), (3)) AS x(m) WHERE m < k) GROUP BY ALL),
c AS (
  SELECT q.lang, q.phrase, q.f AS a, w, k FROM q LEFT JOIN s USING (lang, phrase)
  WHERE k > 1 AND (most IS NULL OR 100 * most < {SUBSUMED_PERCENT} * q.f)),
d AS (SELECT lang, phrase, a, i, array_to_string(w[1 : i], ' ') AS x, array_to_string(w[i + 1 : k], ' ') AS y
      FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
e AS (
  SELECT d.lang, d.phrase, a, u.f AS l, v.f AS r, ({SCALE}::HUGEINT * a // (u.f + v.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY d.lang, d.phrase ORDER BY {SCALE}::HUGEINT * a // (u.f + v.f), i) AS o
  FROM d JOIN q u ON u.lang = d.lang AND u.phrase = x JOIN q v ON v.lang = d.lang AND v.phrase = y),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM g JOIN z USING (lang) WHERE rank <= {TOP}
"""


ORACLE_SQL = _oracle()
