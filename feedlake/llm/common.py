"""What several operators here share: table reading, hidden column names, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """The column called name, also if the name holds dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def map_rows(df: DataFrame, run, *added: tuple[str, str]) -> DataFrame:
    """df.mapInArrow(run) for any column names; run appends columns of the given (name, type).

    mapInArrow looks columns up by name and trips over dots, so names are plain meanwhile.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    new = [F.lit(None).cast(kind).alias(f"n{i}") for i, (_, kind) in enumerate(added)]
    schema = plain.select("*", *new).schema
    return plain.mapInArrow(run, schema).toDF(*df.columns, *[name for name, _ in added])


# Beyond this a quantised component is refused rather than bent to fit a long.
LARGEST = 1 << 62


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for a vector that is null or holds
    null or non-finite components. A component that no long can hold raises."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))

    def whole(v: Column) -> Column:
        large = F.raise_error(F.lit(f"a component times {scale} does not fit a long")).cast("long")
        return F.when(F.abs(v * scale) >= float(LARGEST), large).otherwise(F.floor(v * scale))

    return F.when(finite, F.transform(x, whole))


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links left[i]-right[i]: each node's smallest reachable node."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
    )


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components: (node, root), root the smallest node reachable.

    links holds pairs of longs, in any direction and repeated at will. Only nodes with a
    link to another node come out. Each round turns the written edges into stars around
    smaller nodes (first over all neighbours, then over the smaller ones) until nothing
    changes, about log(n) rounds. Minimums are pre-aggregated before the shuffle, and the
    join that hands them out can be split where one node holds many edges.
    """
    u, v = F.col(left).cast("long"), F.col(right).cast("long")
    edges = (
        links.where(u != v)
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    edges = stage(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = stage(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        own = low.select("u", F.col("m").alias("v"))
        rest = large.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        edges = stage(own.unionByName(rest).distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
