"""The registered queries: against SQL where there is some, and the pipeline against brute force."""

import re

import oracle
import pytest
from llm import helpers, test_texts

import __spark_entry__ as entry
import corpus_pipeline
from feedlake.llm import mixing, queries, secrets
from feedlake.staging import stage

SF_DIR = "/root/testdata/sf0.01"


def test_all_are_registered():
    names = {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES}
    assert names == {str(n) for n in range(1, 14)}
    assert set(entry.queries()) >= {*queries.QUERIES, "pipeline"}
    assert set(entry.oracle_sql()) >= set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    con = oracle.connect(SF_DIR)
    assert oracle.differences(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], SF_DIR) is None


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: awkward documents, near copies, secrets, labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = helpers.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    more = [
        (100, "A text of its own that someone wrote, token = abcdef0123456789abcdef01 and so it goes on here.", "en", "b", 0),
        (101, helpers.PROSE["en"], "en", "b", 0),
        (102, helpers.PROSE["fr"] + " " + "et encore un mot " * 40, "fr", "c", 0),
    ]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (2, 1), (100, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_stage_by_stage(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "SimHash near-dedup", "secret scan", "source mixing", "best-fit packing"]
    made = {}

    def kept_for_later(name, step):
        def run(*args):
            made[name] = stage(step(*args), "step")
            return made[name]

        return run

    monkeypatch.setattr(
        corpus_pipeline, "STAGES", [(n, kept_for_later(n, f)) for n, f in corpus_pipeline.STAGES]
    )
    packed = corpus_pipeline.run(spark, folder)
    kept, alone, masked, mixed = (made[n] for n in names[:4])
    assert all(d.columns == columns for d in (kept, alone, masked, mixed))

    def texts(docs):
        return helpers.rows(docs, "doc_id", "text")

    # The letterless and the very short go, clean documents stay.
    left = {i for i, _ in texts(kept)}
    assert not left & {40, 41, 42, 47} and left >= {*range(40), 100, 101, 102}
    assert set(texts(kept)) <= set(texts(docs))

    groups = test_texts.plain_groups([tuple(r) for r in kept.select("doc_id", "text").collect()])
    assert len({c for _, _, c in groups}) == alone.count()
    assert {i for i, _ in texts(alone)} == {c for _, _, c in groups}

    want = []
    for i, t in texts(alone):
        at, out = 0, ""
        for a, _, b in test_texts.plain_secrets(t):
            if a >= at:
                out += t[at:a] + secrets.MASK
            at = max(at, b)
        want.append((i, out + t[at:]))
    assert texts(masked) == want and any(secrets.MASK in t for _, t in want)

    weights = mixing.quality_weights(spark.read.parquet(f"{folder}/labels.parquet"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(masked, weights).collect()}
    assert texts(mixed) == sorted((r for r in texts(masked) for _ in range(copies[r[0]])), key=repr)

    got = [tuple(r) for r in packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()]
    assert sorted(got, key=repr) == test_texts.plain_pieces(texts(mixed))


def test_pipeline_on_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
