"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed 2-, 3- and 4-letter pieces (a piece
may touch a word's ends, never cross them); a linear softmax over that average names the
language. Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows, on whole texts and on short stretches of them.
A logistic fit on rows kept out of the training turns the lead of the best language, the
length and how usual the text's pieces are in that language into the chance of being
right; the same rows with their letters shuffled stand for texts of no language learned.
A text is rejected below the chance that all but LOST of the right rows reach, which is
never set below one in the number of languages. With fewer than FAMILIAR_ROWS rows kept
out, usualness is left out and that last bound alone rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column, fresh, map_rows

UNKNOWN = "und"
BUCKET_BITS = 14
DIMENSIONS = 16
# Labelled rows in the sample that the driver trains on, over all languages together.
SAMPLE_ROWS = 3000
CALIBRATION_SHARE = 0.2
STRETCH_WORDS = 12
EPOCHS = 6
LEARNING_RATE = 4.0
LOST = 0.005
FAMILIAR_ROWS = 100
SEED = 42
# Characters looked at together; pieces across the border are kept.
CHUNK = 1 << 20

LETTER = regex.compile(r"\p{L}")


def pieces(text: str) -> np.ndarray:
    """Bucket numbers of all subword pieces of a text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    found = []
    for at in range(0, len(codes), CHUNK):
        part = codes[max(0, at - 3) : at + CHUNK]
        kinds, place = np.unique(part, return_inverse=True)
        letter = np.fromiter((chr(k).isalpha() for k in kinds), bool, len(kinds))
        c = np.zeros(len(part) + 2, np.uint32)
        c[1:-1] = np.where(letter[place], part, 0)
        mixed = c * np.uint32(0x9E3779B1)
        inside = c != 0
        for n in (2, 3, 4):
            m = len(c) - n + 1
            if m <= 0:
                continue
            if n == 2:
                valid = inside[:m] | inside[1:]
            else:
                valid = inside[1 : m + 1] if n == 3 else inside[1 : m + 1] & inside[2 : m + 2]
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ mixed[k : k + m]) * np.uint32(0x85EBCA6B)
            found.append((h >> np.uint32(32 - BUCKET_BITS))[valid])
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Languages, each piece's weight and log share in each of them, calibration, rejection mark."""

    languages: list[str]
    weights: np.ndarray
    usual: np.ndarray
    calibration: np.ndarray
    reject_below: float

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[buckets].sum(axis=0) / max(1, len(buckets))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0
        buckets = pieces(text)
        scores = self.logits(buckets)
        best = int(scores.argmax())
        usual = self.usual[buckets, best].sum() / max(1, len(buckets))
        chance = _sigmoid(_evidence(scores, len(buckets), usual)[: len(self.calibration)] @ self.calibration)
        return self.languages[best], float(chance)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _evidence(scores: np.ndarray, n: int, usual: float) -> np.ndarray:
    top = np.sort(scores)[-2:]
    lead = top[-1] - top[0]
    return np.array([1.0, lead, np.log1p(n), usual, usual * np.log1p(n)])


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    ident, lang = column(docs, id_col), column(docs, lang_col)
    return docs.select(
        ident.cast("string").alias("id"),
        column(docs, text_col).cast("string").alias("text"),
        lang.cast("string").alias("lang"),
    ).where(F.crc32("id") % 5 != 0).where("lang IS NOT NULL AND text IS NOT NULL")


def sample_rows(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """About rows labelled rows (id, text, lang), the same number of each language where there are enough.

    They are those whose id's hash falls below a mark that the language's count sets, so
    reruns agree and no task gathers a language; repeated ids count once.
    """
    known = _learnable(docs, id_col, text_col, lang_col)
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    # One row per language, rows of them at most: the most frequent ones.
    counts = counts.orderBy(F.desc("n"), "lang").limit(rows).collect()
    quota = rows / max(1, len(counts))
    cut = {r["lang"]: int((min(1.0, quota / r["n"]) - 0.5) * (2**64 - 2**12)) for r in counts}
    if not cut:
        return known.limit(0)
    marks = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    picked = known.where(F.xxhash64("id", F.lit(SEED)) <= F.element_at(marks, F.col("lang")))
    return picked.groupBy("lang", "id").agg(F.min("text").alias("text"))


def _examples(batches):
    """Counted pieces of each sampled text and of a stretch of it; those held out also as noise."""
    for batch in batches:
        out = {"lang": [], "held": [], "noise": [], "buckets": [], "counts": []}
        for lang, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rng = np.random.default_rng(abs(hash_of(key)))
            held = bool(rng.random() < CALIBRATION_SHARE)
            words = text.split()
            n = int(rng.integers(1, STRETCH_WORDS + 1))
            start = int(rng.integers(0, max(1, len(words) - n)))
            parts = [(text, False), (" ".join(words[start : start + n]), False)]
            if held:
                parts += [(_shuffled(part, rng), True) for part, _ in parts]
            for part, noise in parts:
                buckets, counts = np.unique(pieces(part), return_counts=True)
                if len(buckets):
                    out["lang"].append(lang)
                    out["held"].append(held)
                    out["noise"].append(noise)
                    out["buckets"].append(buckets.astype("<u2").tobytes())
                    out["counts"].append(counts.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["lang"], pa.string()),
                pa.array(out["held"], pa.bool_()),
                pa.array(out["noise"], pa.bool_()),
                pa.array(out["buckets"], pa.binary()),
                pa.array(out["counts"], pa.binary()),
            ],
            names=list(out),
        )


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """text with its letters in another order; what is no letter keeps its place."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").copy()
    letter = np.fromiter((chr(k).isalpha() for k in codes), bool, len(codes))
    codes[letter] = rng.permutation(codes[letter])
    return codes.tobytes().decode("utf-32-le")


def hash_of(key: str) -> int:
    h = 1469598103934665603
    for b in key.encode():
        h = (h ^ b) * 1099511628211 % (1 << 63)
    return h


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from the labelled rows whose crc32(id) mod 5 is not 0.

    Without labelled text the model knows no language.
    """
    sample = sample_rows(docs, id_col, text_col, lang_col, rows)
    found = sample.select("lang", "id", "text").mapInArrow(
        _examples, "lang string, held boolean, noise boolean, buckets binary, counts binary"
    )
    examples = [
        (r.lang, r.held, np.frombuffer(r.buckets, "<u2"), np.frombuffer(r.counts, "<u4"), r.noise)
        for r in found.collect()
    ]
    examples.sort(key=lambda e: (e[0], e[1], e[2].tobytes(), e[3].tobytes(), e[4]))
    return fit(examples)


def fit(examples: list[tuple]) -> Model:
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(3), 0.0)
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    soft = np.zeros((DIMENSIONS, len(languages)), np.float32)
    number = {lang: i for i, lang in enumerate(languages)}
    shares = [(e[3] / e[3].sum()).astype(np.float32) for e in examples]
    train_on = [i for i, e in enumerate(examples) if not e[1]] or [i for i, e in enumerate(examples) if not e[4]]
    steps, done = EPOCHS * len(train_on), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train_on):
            rate = LEARNING_RATE * (1 - done / steps)
            done += 1
            lang, _, buckets, _, _ = examples[i]
            rows = embed[buckets]
            mean = shares[i] @ rows
            p = mean @ soft
            p = np.exp(p - p.max())
            p /= p.sum()
            p[number[lang]] -= 1
            back = soft @ p
            soft -= rate * np.outer(mean, p)
            embed[buckets] = rows - rate * shares[i][:, None] * back
    weights = embed @ soft
    held = [i for i, e in enumerate(examples) if e[1]] or train_on
    familiar = sum(not examples[i][4] for i in held) >= FAMILIAR_ROWS
    seen = np.full((1 << BUCKET_BITS, len(languages)), 0.5)
    for i in train_on:
        lang, _, buckets, counts, _ = examples[i]
        seen[buckets, number[lang]] += counts
    usual = np.log(seen / seen.sum(axis=0)).astype(np.float32)
    rows, right = [], []
    for i in held:
        lang, _, buckets, counts, noise = examples[i]
        if noise and not familiar:
            continue
        scores = shares[i] @ weights[buckets]
        best = int(scores.argmax())
        evidence = _evidence(scores, int(counts.sum()), shares[i] @ usual[buckets, best])
        rows.append(evidence if familiar else evidence[:3])
        right.append(languages[best] == lang and not noise)
    rows, right = np.array(rows), np.array(right)
    calibration = _logistic(rows, right)
    least = 1 / max(2, len(languages))
    if familiar and right.any():
        least = max(least, float(np.quantile(_sigmoid(rows[right] @ calibration), LOST)))
    return Model(languages, weights, usual, calibration, least)


def _logistic(x: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Platt's fit: smoothed targets, a little ridge, Newton steps."""
    yes, no = right.sum(), (~right).sum()
    target = np.where(right, (yes + 1) / (yes + 2), 1 / (no + 2))
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - target) + ridge @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w -= np.linalg.solve(hess, grad)
    return w


def identify(
    docs: DataFrame, model: Model, text_col: str, lang: str, score: str, rejected: str
) -> DataFrame:
    """docs with the language, the chance that it is right, and whether it is rejected.

    A null text and a text without letters get `und`, score 0, and are rejected. A model
    that knows no language names every text `und` and rejects only those. Repeated rows
    get the same answer; whole texts are read, however long; other columns pass through.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            named = [model.predict(t) for t in texts]
            low = [
                s < model.reject_below if model.languages else t is None or not LETTER.search(t)
                for (_, s), t in zip(named, texts)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([n for n, _ in named], pa.string()),
                    pa.array([s for _, s in named], pa.float64()),
                    pa.array(low, pa.bool_()),
                ],
                names=[*batch.schema.names, "n0", "n1", "n2"],
            )

    return map_rows(docs, run, (lang, "string"), (score, "double"), (rejected, "boolean"))


def predictions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, rejected.

    held_out says that crc32 of the id as text is divisible by 5; a null id is not held
    out and not learned from. An empty table gives an empty result.
    """
    model = train(docs, id_col, text_col, lang_col)
    narrow = docs.select(
        column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text")
    )
    named = identify(narrow, model, "text", "lang_pred", "score", "rejected")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return named.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """docs without the rows whose language is rejected; columns as before."""
    model = train(docs, id_col, text_col, lang_col)
    lang, score, rejected = fresh(docs, "langid_lang", "langid_score", "langid_rejected")
    named = identify(docs, model, text_col, lang, score, rejected)
    return named.where(~F.col(rejected)).select(*[column(named, c) for c in docs.columns])
