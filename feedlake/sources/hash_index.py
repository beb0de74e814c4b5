"""The hashes of all stored articles, in sorted runs that a batch reads only parts of.

A batch leaves its hashes as one small table. When enough of them have come together they
are merged into a run: a table partitioned by the first bits of a mixed hash and sorted
inside, with a Bloom filter for each partition. Runs of one size are merged as well, so that there are
few of them and each hash is rewritten a number of times that grows with the logarithm of all.
A batch asks the filters first and opens only the partitions that may hold one of its hashes.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlake.sources.batches import remove
from feedlake.staging import broadcast_if_small, stage

HASH = "contentHash"

# Hashes of single batches are merged into a run from this many on, or this many batches.
RECENT_HASHES = 1 << 20
RECENT_BATCHES = 32
# Runs of one size that are merged into the next size.
RUNS_PER_SIZE = 4
# Hashes of a partition, some 40 MB.
PARTITION_HASHES = 1 << 20
# Bloom filter: bits a hash and bits set for each, about 0.6 % false hits.
BLOOM_BITS = 12
BLOOM_PROBES = 4
# A batch with more hashes than this for each partition of a run reads the run whole.
DENSE = 8
BROADCAST_ROWS = 1_000_000

_KEYS = T.StructType([T.StructField("hash_key", T.BinaryType())])
_PLACED = T.StructType([*_KEYS.fields, T.StructField("prefix", T.IntegerType())])
_FILTER = T.StructType(
    [T.StructField("prefix", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType()))]
)


def hash_key(value: Column) -> Column:
    """The bytes of a hash: half as long as its hexadecimal text. Other texts as they are."""
    return F.coalesce(
        F.unhex(F.when(value.rlike("^[0-9a-f]{64}$"), value)), F.encode(value, "UTF-8")
    )


def _prefix(bits: int) -> Column:
    if bits == 0:
        return F.lit(0)
    return F.shiftrightunsigned(F.xxhash64("hash_key"), 64 - bits).cast("int")


def _bits_for(hashes: int) -> int:
    return max(0, math.ceil(math.log2(max(1, hashes) / PARTITION_HASHES)))


def _words(run: dict) -> int:
    """Longs of the filter of one partition."""
    return max(1, -(-run["hashes"] * BLOOM_BITS // (64 << run["bits"])))


def _probe(i: int, words: int) -> Column:
    """Which bit of a filter the i-th probe of a hash is."""
    return F.pmod(F.xxhash64("hash_key", F.lit(i)), F.lit(words * 64))


class HashIndex:
    """Runs and recent batches of hashes under a folder, as a manifest names them."""

    def __init__(self, spark: SparkSession, folder: str, runs: list, recent: list):
        self.spark, self.folder = spark, folder
        self.runs, self.recent = list(runs), list(recent)
        self.gone: list[str] = []

    def _run_path(self, run: dict) -> str:
        return f"{self.folder}/runs/run={run['run']}"

    def _filter_path(self, run: dict) -> str:
        return f"{self.folder}/filters/run={run['run']}"

    def _recent_path(self, recent: dict) -> str:
        return f"{self.folder}/recent/batch={recent['batch']}"

    @property
    def hashes(self) -> int:
        return sum(p["hashes"] for p in [*self.runs, *self.recent])

    def run(self, run: dict) -> DataFrame:
        return self.spark.read.schema(_PLACED).parquet(self._run_path(run))

    def _recents(self) -> DataFrame:
        if not self.recent:
            return self.spark.createDataFrame([], _KEYS)
        return self.spark.read.schema(_KEYS).parquet(*[self._recent_path(r) for r in self.recent])

    def candidates(self, keys: DataFrame, run: dict) -> DataFrame:
        """Keys with the partition that may hold them, by the run's filters."""
        words = _words(run)
        placed = keys.select("hash_key", _prefix(run["bits"]).alias("prefix"))
        filters = self.spark.read.schema(_FILTER).parquet(self._filter_path(run))
        if run["bits"]:
            # Only the filters of the batch's own prefixes are read, by the statistics of their files.
            low, high = placed.agg(F.min("prefix"), F.max("prefix")).first()
            filters = filters.where(F.col("prefix").between(low, high))
        asked = placed.join(filters, "prefix")
        for i in range(BLOOM_PROBES):
            bit = _probe(i, words)
            word = F.get("words", F.floor(bit / 64).cast("int"))
            asked = asked.where(F.getbit(word, (bit % 64).cast("int")) == 1)
        return asked.select("hash_key", "prefix")

    def _in_run(self, keys: DataFrame, n_keys: int, run: dict) -> DataFrame:
        """The keys that a run holds."""
        held = self.run(run)
        if n_keys > DENSE << run["bits"]:
            return held.select("hash_key").join(broadcast_if_small(keys, BROADCAST_ROWS, n_keys), "hash_key", "left_semi")
        maybe = stage(self.candidates(keys, run), "may-be-stored")
        # At most one prefix for each key, and no more than the run has partitions.
        prefixes = [r["prefix"] for r in maybe.select("prefix").distinct().toLocalIterator()]
        wanted = held.where(F.col("prefix").isin(prefixes) if prefixes else F.lit(False))
        return wanted.select("hash_key").join(F.broadcast(maybe.select("hash_key")), "hash_key", "left_semi")

    def known(self, keys: DataFrame, n_keys: int) -> DataFrame:
        """Those of the distinct keys (hash_key) that are stored."""
        if n_keys == 0:
            return keys.limit(0)
        small = broadcast_if_small(keys, BROADCAST_ROWS, n_keys)
        found = self._recents().join(small, "hash_key", "left_semi")
        for run in self.runs:
            found = found.unionByName(self._in_run(keys, n_keys, run))
        return found

    def new_against(self, rows: DataFrame, n_rows: int) -> DataFrame:
        """The rows, of distinct hashes, whose hash is not stored."""
        keyed = rows.withColumn("hash_key", hash_key(F.col(HASH)))
        if not self.runs and not self.recent:
            return rows
        known = self.known(keyed.select("hash_key"), n_rows)
        # No more keys are known than were asked for.
        known = F.broadcast(known) if n_rows <= BROADCAST_ROWS else known
        return keyed.join(known, "hash_key", "left_anti").drop("hash_key")

    def add(self, batch: int, hashes: DataFrame, n_hashes: int) -> None:
        """Take up the hashes of a batch; merge what has become enough.

        What a merge replaces is only listed, to be removed once the batch is closed.
        """
        if n_hashes == 0:
            return
        keys = hashes.select(hash_key(F.col(HASH)).alias("hash_key"))
        recent = {"batch": batch, "hashes": n_hashes}
        files = -(-n_hashes // RECENT_HASHES)
        keys.coalesce(files).write.mode("overwrite").parquet(self._recent_path(recent))
        self.recent.append(recent)
        if sum(r["hashes"] for r in self.recent) >= RECENT_HASHES or len(self.recent) >= RECENT_BATCHES:
            self.merge(batch)

    def merge(self, batch: int) -> None:
        """Merge the hashes of recent batches into a run named after this batch."""
        total = sum(r["hashes"] for r in self.recent)
        merged, size = self._recents(), self._size(total)
        self.gone += [self._recent_path(r) for r in self.recent]
        self.recent = []
        # A run of the same size joins in as soon as there are enough of them.
        while True:
            same = [r for r in self.runs if self._size(r["hashes"]) <= size]
            if len(same) < RUNS_PER_SIZE - 1:
                break
            for run in same:
                merged = merged.unionByName(self.run(run).select("hash_key"))
                total += run["hashes"]
                self.gone += [self._run_path(run), self._filter_path(run)]
            self.runs = [r for r in self.runs if r not in same]
            size = self._size(total)
        self._write_run(batch, merged, total)

    @staticmethod
    def _size(hashes: int) -> int:
        return int(math.log(max(1, hashes), RUNS_PER_SIZE))

    def _write_run(self, batch: int, keys: DataFrame, hashes: int) -> None:
        run = {"run": batch, "hashes": hashes, "bits": _bits_for(hashes)}
        placed = keys.select("hash_key", _prefix(run["bits"]).alias("prefix"))
        (
            placed.repartition(F.col("prefix"))
            .sortWithinPartitions("prefix", "hash_key")
            .write.mode("overwrite")
            .partitionBy("prefix")
            .parquet(self._run_path(run))
        )
        words = _words(run)
        bits = self.run(run).select(
            "prefix", F.explode(F.array(*[_probe(i, words) for i in range(BLOOM_PROBES)])).alias("bit")
        )
        one = F.lit(1).cast("long")
        shift = (F.col("bit") % 64).cast("int")
        # Every word of a filter that is needed exists, if only as zero.
        blank = (
            self.run(run)
            .select("prefix")
            .distinct()
            .select("prefix", F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("word"), (one * 0).alias("set"))
        )
        filters = (
            bits.select(
                "prefix", F.floor(F.col("bit") / 64).cast("int").alias("word"), F.call_function("shiftleft", one, shift).alias("set")
            )
            .unionByName(blank)
            .groupBy("prefix", "word")
            .agg(F.bit_or("set").alias("set"))
            .groupBy("prefix")
            .agg(F.sort_array(F.collect_list(F.struct("word", "set"))).alias("w"))
            .select("prefix", F.col("w.set").alias("words"))
        )
        files = max(1, words * (1 << run["bits"]) // (1 << 24))
        filters.repartitionByRange(files, "prefix").sortWithinPartitions("prefix").write.mode("overwrite").parquet(self._filter_path(run))
        self.runs.append(run)

    def remove_gone(self) -> None:
        for path in self.gone:
            remove(self.spark, path)
        self.gone = []
