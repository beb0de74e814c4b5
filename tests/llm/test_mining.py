"""Decontamination, hard negatives and collocations, against brute force and on awkward rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import helpers
from llm.test_vectors import odd_vectors, sound, vectors
from pyspark.sql import functions as F

from feedlake.llm import collocations, decontamination, negatives

# --- decontamination --------------------------------------------------------------

LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(text, items, n=10):
    """(words, hit words, items) of one text."""
    words, hit, held = plain_words(text), set(), set()
    for item, body in items:
        w = plain_words(body)
        size = min(n, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            for b in range(len(words) - size + 1):
                if words[b : b + size] == w[a : a + size]:
                    hit |= set(range(b, b + size))
                    held.add(item)
    return words, hit, held


ITEMS = [
    (1, "One two THREE four five six seven eight nine ten eleven twelve"),
    (2, "kilo, lima; mike"),
    (10, "three-four-five-six-seven-eight-nine-ten-eleven-twelve-thirteen"),
    (3, ""),
    (4, None),
    (5, "... !!"),
    (None, "only of a nameless item"),
    (1, "ä ö ü"),
    (6, "KK kelvin"),
]
TEXTS = [
    "Said: one, two three. FOUR five six seven eight nine ten and more",
    "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen kilo lima mike kilo lima mike",
    "kilo lima",
    "Kilo LIMA mike!",
    "-kilo lima mike-lima mike kilo lima mike",
    "ä-ö-ü Ä ö ü",
    "kK KELVIN",
    "only of a nameless item",
    "one two three four five six seven eight nine",
    None,
    "",
    "?!",
]


def item_frame(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, 7, "w") for i, t in items], "item_id long, text string, `odd.name` int, words string")


def text_frame(spark, texts):
    docs = helpers.documents(spark)
    more = [(900 + k, t, "en", "b", 1, "x", 1, "r", 2, "b", 0.5, "o") for k, t in enumerate(texts)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


@pytest.mark.parametrize("bytes_", [48 << 20, 700])
def test_decontamination_on_odd_rows(spark, monkeypatch, bytes_):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bytes_)
    docs = text_frame(spark, TEXTS)
    scanned = decontamination.scan(docs, item_frame(spark)).collect()
    want = []
    for i, text in [tuple(r) for r in docs.select("doc_id", "text").collect()]:
        words, hit, held = plain_hits(text, ITEMS)
        want.append((i, len(words), len(hit), sorted(str(x) for x in held if x is not None)))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in scanned), key=repr) == sorted(want, key=repr)
    for r in scanned:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_decontamination_of_empty_tables(spark):
    docs, items = text_frame(spark, TEXTS), item_frame(spark)
    assert decontamination.scan(helpers.empty(docs), items).count() == 0
    clean = decontamination.digests(decontamination.scan(docs, helpers.empty(items)))
    assert clean.where("contaminated").count() == 0 and clean.count() == docs.count()


def test_cleaning_documents(spark):
    docs, items = text_frame(spark, TEXTS), item_frame(spark)
    kept = decontamination.clean(docs, items)
    dirty = {900 + k for k, t in enumerate(TEXTS) if plain_hits(t, ITEMS)[1]}
    assert kept.columns == docs.columns
    want = [r for r in helpers.rows(docs, "doc_id", "text", "`odd.name`") if r[0] not in dirty]
    assert helpers.rows(kept, "doc_id", "text", "`odd.name`") == want


def without(text, hit):
    """The text without its hit words and the gaps between two of them."""
    words = list(re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text or ""))
    out, at = "", 0
    for k, w in enumerate(words):
        if k in hit:
            if k - 1 not in hit:
                out += text[at : w.start()]
            at = w.end()
    return text if text is None else out + text[at:]


def test_cleaning_spans(spark):
    docs, items = text_frame(spark, TEXTS), item_frame(spark)
    cut = decontamination.clean(docs, items, "spans")
    want = [(i, without(t, plain_hits(t, ITEMS)[1]), o) for i, t, o in helpers.rows(docs, "doc_id", "text", "`odd.name`")]
    assert cut.columns == docs.columns
    assert helpers.rows(cut, "doc_id", "text", "`odd.name`") == sorted(want, key=repr)
    with pytest.raises(ValueError):
        decontamination.clean(docs, items, "words")


def test_a_passage_in_a_third_of_all_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    texts = [f"text {k} {passage if k % 3 == 0 else 'clean'} end" for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontamination.scan(docs, item_frame(spark)).where("n_hit = 11 AND items[0] = '1'")
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(0, 300, 3))


# --- hard negatives ---------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_intervals_hold_the_products(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 60)), int(rng.choice([1, 2, 3, 16, 64, 100, 256]))
    high = int(rng.choice([1, 2, 300, 1 << 20]))
    rows, x = rng.integers(-high, high, (n, d)), rng.integers(-high, high, d)
    if rng.random() < 0.3:
        rows[rng.integers(n)] = x
    low, top = negatives.Query(x).intervals(*negatives.codes(rows))
    true = rows @ x
    assert (low <= true).all() and (true <= top).all()


def test_intervals_tell_near_from_far():
    rng = np.random.default_rng(0)
    x = rng.integers(-256, 256, 256)
    rows = np.concatenate([x + rng.integers(-20, 20, (50, 256)), rng.integers(-256, 256, (950, 256))])
    left = negatives.surviving(negatives.Query(x), rows, *negatives.codes(rows), 5)
    assert set(np.argsort(-(rows @ x))[:5]) <= set(left) and len(left) < 100


def plain_negatives(rows, step=20):
    able = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, label) in enumerate(able):
        if i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j, b) for b, (j, v, _) in enumerate(able) if b != a and len(v) == len(q)]
        for p, j, _ in sorted(s for s in scored if able[s[2]][2] == label)[:5]:
            band = sorted(s for s in scored if able[s[2]][2] != label and -80 * p <= -100 * s[0] <= -100 * p)
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(band[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("components", [1 << 19, 40])
def test_hard_negatives_on_odd_rows(spark, monkeypatch, components):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", components)
    frame, rows = odd_vectors(spark)
    got = negatives.mine(frame, F.col("id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert negatives.mine(helpers.empty(frame), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("width, size", [(300, 1.0), (4, float(1 << 28))])
def test_hard_negatives_of_long_and_large_vectors(spark, width, size):
    rng = np.random.default_rng(4)
    base = rng.normal(size=width)
    rows = [(i, np.float32((base + 0.4 * rng.normal(size=width)) * size * (10 ** -4 if i % 20 else 1.0) / 4).tolist(), i % 3) for i in range(80)]
    if size > 1:
        rows = [(i, v, c) for i, v, c in rows if i % 20 or i == 40]
    got = negatives.mine(vectors(spark, rows), F.col("id") % 20 == 0)
    want = plain_negatives(rows)
    assert want and sorted(map(tuple, got.collect())) == want


def test_a_score_beyond_a_long_raises(spark):
    rows = [(i, [float(1 << 40), float(1 << 30)], i % 2) for i in range(8)]
    with pytest.raises(Exception, match="does not fit a long"):
        negatives.mine(vectors(spark, rows), F.col("id") % 4 == 0).collect()


# --- collocations -----------------------------------------------------------------


def plain_phrases(rows, min_count, top):
    """Each language's phrases, counted one by one."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        f = counts[lang or "und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                f.update(tuple(w[s : s + k]) for s in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        able = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        dropped = set()
        for p, c in able.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    if 100 * c >= 80 * f[p[s : s + k]]:
                        dropped.add(p[s : s + k])
        ranked = []
        for p, a in able.items():
            if p not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for r, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n, -s))
    return sorted(out, key=repr)


COLLOCATION_COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("words, bits, top", [(1 << 20, 1 << 16, 2000), (50, 1 << 15, 40)])
def test_collocations_against_counting(spark, monkeypatch, words, bits, top):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", words)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 4 * words)
    monkeypatch.setattr(collocations, "LEAST_BITS", bits)
    rng = np.random.default_rng(8)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "É", "x\x1cy", "\x00", " ", "a b"] + [f"w{i}" for i in range(30)]
    odds = 1 / np.arange(1, len(vocabulary) + 1)
    joints = [" ", " ", " ", " ", "  ", "\t", " \t ", ", ", ". ", "\n", "\r\n", "\x0b", "?!", ":"]
    rows = []
    for _ in range(150):
        n = int(rng.integers(0, 60))
        drawn = rng.choice(vocabulary, n, p=odds / odds.sum())
        text = "".join(w + rng.choice(joints) for w in drawn) + "new york city hall"[: int(rng.integers(0, 19))]
        rows.append((text, str(rng.choice(["en", "fr", ""])) if rng.random() < 0.8 else None))
    rows += [(None, "en"), ("", None), (" .. ", "xx"), ("of " * 4000, "en"), ("solo", "de")] * 2
    docs = spark.createDataFrame([(*r, 1, "p", "q") for r in rows], "text string, lang string, n int, phrase string, `odd.name` string").repartition(5)
    got = collocations.phrases(docs, min_count=6, top=top)
    assert helpers.rows(got, *COLLOCATION_COLUMNS) == plain_phrases(rows, 6, top)
    assert collocations.phrases(helpers.empty(docs)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 1 << 60
    got = spark.range(1).select(
        collocations._score(F.lit(big), F.lit(2 * big + 1).cast("decimal(25,0)")).alias("s")
    ).first()["s"]
    assert got == 2_000_000 * big // (2 * big + 1)


def test_no_pair_misses_the_bitmap(spark):
    pairs = [("en", f"a{i} b{i * 7}") for i in range(500)]
    frame = spark.createDataFrame(pairs, "lang string, phrase string")
    bitmap = np.frombuffer(collocations.pair_bitmap(frame, 500), np.uint8)
    tongue = collocations._hashes([b"en"] * 500)
    words = [p.encode().split() for _, p in pairs]
    at = collocations._pair_bits(tongue, collocations._hashes([w[0] for w in words]), collocations._hashes([w[1] for w in words]), len(bitmap) * 8)
    assert ((bitmap[at >> 3] >> (at & 7)) & 1).all() and np.bitwise_count(bitmap).sum() <= 500
