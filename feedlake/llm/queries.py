"""The operations as queries over the whole given tables, with SQL where it can say the same."""

from pyspark.sql import functions as F

from feedlake.llm import (
    bitsliced,
    chat,
    collocations,
    crosspolytope,
    decontamination,
    disclosure,
    langid,
    licences,
    mixing,
    negatives,
    packing,
    secrets,
    simhash,
)
from feedlake.llm.common import table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


@query(mixing.ORACLE_SQL)
def op1_mixing(spark, sf_dir):
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights)


@query()
def op2_pii(spark, sf_dir):
    return disclosure.scan(table(spark, sf_dir, "documents"))


@query()
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query(bitsliced.ORACLE_SQL)
def op4_bitsliced(spark, sf_dir):
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


@query(licences.ORACLE_SQL)
def op5_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query()
def op6_crosspolytope(spark, sf_dir):
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op8_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query()
def op9_langid(spark, sf_dir):
    return langid.predictions(table(spark, sf_dir, "documents"))


@query(chat.ORACLE_SQL)
def op10_chat(spark, sf_dir):
    turns = chat.with_test_conversation(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.examples(turns))


@query(decontamination.ORACLE_SQL)
def op11_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digests(decontamination.scan(docs, items))


@query(negatives.ORACLE_SQL)
def op12_hard_negatives(spark, sf_dir):
    vectors = negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return negatives.mine(vectors, F.col("id") % negatives.ANCHOR_STEP == 0)


@query(collocations.ORACLE_SQL)
def op13_collocations(spark, sf_dir):
    return collocations.phrases(table(spark, sf_dir, "documents"))
