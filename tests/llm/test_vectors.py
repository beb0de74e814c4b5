"""Operations on vectors and conversations, against brute force and on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import helpers
from pyspark.sql import functions as F

from feedlake.llm import bitsliced, chat, crosspolytope
from feedlake.llm.common import local_roots

VECTORS = "vec_id long, embedding array<float>, label int, id string, q int, `odd.name` string, row string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "o", "r") for r in rows], VECTORS)


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [math.cos(i), math.sin(i), i / 50], i % 2) for i in range(0, 120)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0, 0.0, 0.0], 0), (203, [1.0, None, 0.0], 1)]
    rows += [(204, [nan, 0.0, 1.0], 0), (250, [inf, 0.0, 1.0], 0), (206, [1.0, 2.0, 3.0], None)]
    rows += [(300, [0.5, 0.5], 0), (301, [0.5, 0.5], 0), (100, rows[100][1], 0), (None, [1.0, 0.0, 0.0], 1)]
    rows += [(1000 + i, [0.6, 0.8, 0.01], 1) for i in range(30)]
    return vectors(spark, rows), rows


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


# --- top-k ----------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_bit_arithmetic_equals_multiplication(seed):
    rng = np.random.default_rng(seed)
    n, d, high = int(rng.integers(1, 200)), int(rng.integers(1, 12)), int(rng.choice([1, 3, 200, 1 << 26]))
    matrix, weights = rng.integers(-high, high, (n, d)), rng.integers(-high, high, d)
    low, slices = bitsliced.build(matrix)
    skip, k = int(rng.integers(-1, n)), int(rng.integers(1, 8))
    best, scores = bitsliced.top_rows(low, slices, n, weights, skip, k)
    true = matrix @ weights
    order = [i for i in np.lexsort((np.arange(n), -true)) if i != skip][:k]
    assert sorted(zip(best.tolist(), scores.tolist())) == sorted((i, int(true[i])) for i in order)


def plain_top(rows, step=50, k=5):
    able = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and (v == [] or sound(v))]
    out = []
    for a, (i, q) in enumerate(able):
        if i % step == 0:
            scored = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(able) if b != a and len(v) == len(q)]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_per_block, per_chunk", [(12_288, 1024), (16, 2)])
def test_top_k_on_odd_rows(spark, monkeypatch, rows_per_block, per_chunk):
    monkeypatch.setattr(bitsliced, "BLOCK_COMPONENTS", 64 * rows_per_block)
    monkeypatch.setattr(bitsliced, "CHUNK_QUERIES", per_chunk)
    frame, rows = odd_vectors(spark)
    got = bitsliced.top_k(frame)
    assert sorted(map(tuple, got.collect())) == plain_top(rows)
    assert bitsliced.top_k(helpers.empty(frame)).count() == 0


@pytest.mark.parametrize("width, rows", [(1536, 100), (4096, 60)])
def test_top_k_of_long_vectors(spark, monkeypatch, width, rows):
    monkeypatch.setattr(bitsliced, "BLOCK_COMPONENTS", 40 * width)
    rng = np.random.default_rng(width)
    given_rows = [(i, np.float32(rng.normal(size=width) / 40).tolist(), 0) for i in range(rows)]
    got = sorted(map(tuple, bitsliced.top_k(vectors(spark, given_rows)).collect()))
    assert got == plain_top(given_rows) and len(got) == 5 * -(-rows // 50)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    given_rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(60)]
    given_rows += [(60, [300_000.0, 0.0, 0.0, 0.0], 0), (61, [-1.0, float(1 << 30), 0.0, 1.0], 0), (62, [0.0, -float(1 << 30), 2.0, 0.0], 0)]
    got = sorted(map(tuple, bitsliced.top_k(vectors(spark, given_rows)).collect()))
    assert got == plain_top(given_rows) and {61, 62} & {r[2] for r in got}


def test_top_k_scores_beyond_a_long_raise(spark):
    both = [(50, [float(1 << 30), 0.0], 0), (51, [float(1 << 30), 1.0], 0)]
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_k(vectors(spark, both)).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_k(vectors(spark, [(50, [1e30], 0)])).collect()


# --- near-duplicates --------------------------------------------------------------


def plain_links(rows, threshold=0.98):
    left, right = [], []
    for a, (_, v, label) in enumerate(rows):
        for b in range(a):
            w = rows[b][1]
            if label is None or rows[b][2] != label or not (sound(v) and sound(w)) or len(v) != len(w):
                continue
            x, y = np.float32(v).astype(float), np.float32(w).astype(float)
            if x.any() and y.any() and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                left.append(a)
                right.append(b)
    left, right = np.array(left, int), np.array(right, int)
    links = np.bincount(np.r_[left, right], minlength=len(rows))
    root, low = local_roots(len(rows), left, right), {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(i, low.get(r, i))
    return sorted(((i, int(n), low.get(r), i == low.get(r)) for (i, _, _), n, r in zip(rows, links, root)), key=repr)


@pytest.mark.parametrize("tile, small, product", [(4 << 20, 48, 1024), (8 * 33 * 8, 2, 3), (4 << 20, 2, 7)])
def test_near_vectors_on_odd_rows(spark, monkeypatch, tile, small, product):
    monkeypatch.setattr(crosspolytope, "TILE_BYTES", tile)
    monkeypatch.setattr(crosspolytope, "PRODUCT_ROWS", product)
    monkeypatch.setattr(crosspolytope, "SMALL_CELL", small)
    frame, rows = odd_vectors(spark)
    got = crosspolytope.near_duplicates(frame)
    assert helpers.rows(got, "vec_id", "n_links", "component_id", "kept") == plain_links(rows)
    assert crosspolytope.near_duplicates(helpers.empty(frame)).count() == 0


@pytest.mark.parametrize("width, hashes", [*((64, h) for h in (1, 2, 3, 4)), (16, 2), (16, 4), (256, 1), (256, 4), (1024, 2)])
def test_recall_at_the_threshold(width, hashes):
    rng = np.random.default_rng(hashes)
    x = crosspolytope.unit(rng.normal(size=(3000 if width <= 64 else 400, width)))
    e = rng.normal(size=x.shape)
    e = crosspolytope.unit(e - (e * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * e
    a, b = crosspolytope.bucket_codes(x, hashes), crosspolytope.bucket_codes(y, hashes)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.97
    far = crosspolytope.bucket_codes(crosspolytope.unit(rng.normal(size=x.shape)), hashes)
    assert (a[:, :, None] == far[:, None, :]).any(axis=(1, 2)).mean() < 0.6


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = crosspolytope.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(crosspolytope.hadamard(y), x)


def test_large_groups_of_near_copies_are_counted_in_full(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist(), 0) for i in range(400)]
    rows += [(400 + i, base.tolist(), 0) for i in range(300)] + [(900 + i, rng.normal(size=16).tolist(), 0) for i in range(50)]
    got = crosspolytope.near_duplicates(vectors(spark, rows))
    assert helpers.rows(got, "vec_id", "n_links", "component_id", "kept") == plain_links(rows)


# --- chat -------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, body string, `odd.name` int"


def plain_digests(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha(whole), len(said), sha(said)))
    return sorted(out, key=repr)


PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "&amp;", "&lt;", "&", "\n", "é", "x", "\\", "$1", ";"]


@pytest.mark.parametrize("part", [256, 2])
def test_chat_round_trip(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_EXAMPLES", part)
    rng = np.random.default_rng(2)
    roles = ["user", "assistant", "system", None, "assistant", "odd\nrole <|end|>"]
    rows = [
        (int(c), int(t), roles[rng.integers(6)], "".join(rng.choice(PIECES, rng.integers(0, 12))))
        for c in range(60)
        for t in range(rng.integers(1, 9))
    ]
    rows += [(70, 1, "user", "x"), (70, 1, "user", "x"), (71, None, "assistant", None), (None, 0, "assistant", "y"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, "b", 1) for r in rows], TURNS)
    made = chat.examples(frame)
    got = helpers.rows(chat.digests(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == plain_digests(rows)
    for r in made.collect():
        text = r["formatted"]
        assert text.count("<|turn|>") == text.count("<|end|>\n") and not any(x in text for x in PIECES[:4])
        if r["loss_start"] is not None:
            assert text[r["loss_end"] :] == "<|end|>\n"
            assert text[: r["loss_start"]].endswith("<|turn|>assistant\n")
    assert chat.digests(chat.examples(helpers.empty(frame))).count() == 0


def test_every_reply_is_one_example_with_all_turns_before_it(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}", "b", 1) for t in range(7)]
    made = chat.examples(spark.createDataFrame(rows, TURNS)).orderBy("example").collect()
    assert [(r["example"], r["complete"]) for r in made] == [(2, False), (4, False), (6, False), (7, True)]
    assert all(made[3]["formatted"].startswith(r["formatted"]) for r in made)
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in made[:3]] == ["text 1", "text 3", "text 5"]


def test_one_long_conversation_is_dealt_to_several_tasks(spark):
    """A conversation of very many turns: right examples, and time about as what they hold."""
    turns = spark.range(4001).selectExpr(
        "1L AS conv_id", "id AS turn", "if(id % 2 = 1, 'assistant', 'user') AS role", "concat('é ', id) AS text"
    )
    made = chat.examples(turns)
    got = made.agg(F.count("*"), F.sum("example"), F.count_if("complete")).first()
    assert got == (2001, sum(range(2, 4001, 2)) + 4001, 1)
    assert made.select(F.spark_partition_id()).distinct().count() > 1
    wrong = made.where("loss_start IS NOT NULL").where(
        "substr(formatted, loss_start + 1, loss_end - loss_start) <> concat('é ', example - 1)"
    )
    assert wrong.count() == 0
    rows = [(1, t, "assistant" if t % 2 else "user", f"é {t}") for t in range(4001)]
    assert helpers.rows(chat.digests(made), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == plain_digests(rows)
