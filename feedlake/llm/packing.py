"""Best-fit packing of tokenised documents into sequences, large pieces matched first.

Documents become token ids and an end id; only longer ones are cut. How pieces share
sequences depends on their lengths alone, so the plan is made on the histogram of lengths,
which has as many entries as a sequence has tokens, whatever the corpus holds: pieces above
a third of a sequence are matched greedily, largest with the largest that still fits, at
most two in a sequence; smaller ones, longest first, go where they leave the least room.
Runs of equal sequences are handled as one. Pieces are then numbered within their length
and take the places the plan has for that length.
"""

from __future__ import annotations

import bisect
import os
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlake.llm.common import column
from feedlake.staging import stage

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
# Words whose ids a Python worker keeps; beyond it starts afresh.
KEPT_WORDS = 1_000_000
LEARNED_AT_ONCE = 20_000
# A word of its own between the words that are encoded together.
MARK = b"\x01"
# What the vocabulary's last token of a word ends with.
WORD_END = "</w>"
# Numbering splits each length into this many groups, more where groups would pass this size.
GROUPS = 64
GROUP_PIECES = 1_000_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordEncoder:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those
    of its words in turn. Case does not count, and a full stop or comma after an ASCII
    letter or digit is a token of its own. Words seen before are looked up; new ones are
    encoded together: those that are letters alone once composed end with an end-of-word
    token, between others stands a mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        (self.mark,) = self._ids(MARK.decode()).tolist()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.stops = {c: self._ids(c.decode()).tobytes() for c in (b".", b",")}

    def _ids(self, text: str) -> np.ndarray:
        (encoding,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(encoding.ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        """Adds words that are not known and do not end with a stop of their own."""
        letters, others = [], []
        for word in words:
            if MARK in word or b"<|" in word:
                self.known[word] = self._ids(word.decode()).tobytes()
            # As the tokenizer composes them: some letters become a letter and a mark, which ends
            # a token of its own. The one letter whose lower case is not a letter alone is left out.
            elif word.isalpha() or (text := unicodedata.normalize("NFC", word.decode())).isalpha() and "\u0130" not in text:
                letters.append(word)
            else:
                others.append(word)
        for kind, joint in ((letters, b" "), (others, b" " + MARK + b" ")):
            for at in range(0, len(kind), LEARNED_AT_ONCE):
                part = kind[at : at + LEARNED_AT_ONCE]
                ids = self._ids(joint.join(part).decode())
                if joint == b" ":
                    cuts = np.flatnonzero(self.ends[ids])[:-1] + 1
                    own = [x.tobytes() for x in np.split(ids, cuts)]
                else:
                    cuts = np.flatnonzero(ids == self.mark)
                    own = [x[x != self.mark].tobytes() for x in np.split(ids, cuts)]
                self.known.update(zip(part, own, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = []
        for text in texts:
            raw = (text or "").encode()
            # A control string is one in lower case only.
            split.append((raw if b"<|" in raw else raw.lower()).split())
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = set().union(*split)
        stopped = {w: w[:-1] for w in new if w[-1:] in self.stops and w[-2:-1].isalnum()}
        stems = (new - stopped.keys()).union(stopped.values()).difference(self.known)
        self._learn(list(stems))
        for word, stem in stopped.items():
            self.known[word] = self.known[stem] + self.stops[word[-1:]]
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _encoder(path: str) -> WordEncoder:
    """This worker's encoder; it outlives the task, whose own globals do not."""
    kept = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = WordEncoder(path)
    return kept.__dict__[path]


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids (little-endian 32 bit)."""
    path = path or vocabulary_path()
    narrow = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    schema = narrow.select(
        "id",
        F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.lit(0).cast("long").alias("length"),
        F.lit(b"").alias("ids"),
    ).schema
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, piece, ids = [], [], []
                for i, own in enumerate(encoder.encode(part.column(1).to_pylist())):
                    own += end
                    for k, begin in enumerate(range(0, len(own), 4 * capacity)):
                        row.append(i)
                        piece.append(k)
                        ids.append(own[begin : begin + 4 * capacity])
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(number * capacity),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["id", "piece", "start", "length", "ids"],
                )

    return narrow.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for counts[length] pieces of each length: (length, first, n, sequence, offset).

    Pieces first .. first + n - 1 of that length go to sequences sequence .. sequence + n - 1
    at the offset. The number of entries depends on the lengths, not on how many pieces there are.
    """
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    places, sequences = [], 0
    # Room left -> runs (first sequence, number of sequences) with that much room.
    open_: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        places.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        top = large[-1]
        if not left[top]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - top) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        mate = large[at] if at >= 0 else None
        n = left[top] if mate is None else min(left[top], left[mate])
        if mate == top:
            n = left[top] // 2
            mate, n = (top, n) if n else (None, left[top])
        put(top, n, sequences, 0)
        room = capacity - top
        if mate is not None:
            put(mate, n, sequences, top)
            room -= mate
        if room:
            open_.setdefault(room, []).append((sequences, n))
        sequences += n
    rooms = sorted(open_)
    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                # As many new sequences as the pieces of this length fill.
                n = -(-left[length] // (capacity // length))
                run, room = (sequences, n), capacity
                sequences += n
            else:
                room = rooms[at]
                run = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            first, size = run
            n = min(size, left[length])
            put(length, n, first, capacity - room)
            for rest, (start, many) in (
                (room - length, (first, n)),
                (room, (first + n, size - n)),
            ):
                if rest and many:
                    if rest not in open_:
                        bisect.insort(rooms, rest)
                    open_.setdefault(rest, []).append((start, many))
    return places


def place(narrow: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """narrow with sequence_id and offset for each piece; it needs id, piece and length, and is written.

    The driver sees the histogram of lengths, at most capacity rows. A length that many
    pieces share is numbered in groups of its own.
    """
    groups = max(GROUPS, narrow.count() // GROUP_PIECES)
    mixed = F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).alias("_group")
    grouped = narrow.select("*", mixed)
    sizes = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    sizes = stage(sizes, "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places = plan(counts, capacity)
    table: dict[int, tuple] = {}
    for length in counts:
        own = [p for p in places if p[0] == length]
        table[length] = tuple(np.array(x, np.int64) for x in zip(*[p[1:] for p in own]))
    before = W.partitionBy("length").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = [c for c in narrow.columns if c not in ("id", "piece", "length")]
    inside = W.partitionBy("length", "_group").orderBy("id", "piece", *order)
    numbered = grouped.join(starts, ["length", "_group"]).withColumn(
        "_rank", F.col("_start") + F.row_number().over(inside) - 1
    )
    numbered = numbered.select(*narrow.columns, "_rank")
    schema = narrow.select(
        "*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    ).schema
    at = narrow.columns.index("length")

    def run(batches):
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            ranks = batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                first, _, start, begin = table[int(length)]
                entry = np.searchsorted(first, ranks[rows], side="right") - 1
                sequence[rows] = start[entry] + ranks[rows] - first[entry]
                offset[rows] = begin[entry]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat an id are packed one by one.
    Whole texts are encoded, however long. An empty table gives an empty result; extra
    columns are not read. The tokenizer's file must have the same path on all executors.
    """
    cut = pieces(docs, id_col, text_col, path, capacity)
    narrow = stage(cut.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return place(narrow, capacity).withColumnRenamed("id", id_col)


def sequences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian 32 bit), pieces (id, offset, length in order)."""
    cut = stage(pieces(docs, id_col, text_col, path, capacity), "token-ids")
    placed = place(cut, capacity)
    part = F.struct("offset", "length", "id", "piece", "ids")
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["id"].alias(id_col), p["offset"].alias("offset"), p["length"].alias("length"))).alias("pieces"),
    )
