"""Manifests of the store's batches: what makes a batch count once, and wholly.

Every batch of articles has a number and a key that says what it was made from. Its
manifest is a small file, written open, with the planned ids and counts, before anything is
appended, and written closed when all of the batch is in place. Readers go by the last
closed batch, so a batch that broke off is not seen; the next writer takes its number
and overwrites what it left. A key that is closed is not taken a second time.
"""

import json
import re
from dataclasses import asdict, dataclass, field, replace
from hashlib import md5

from pyspark.sql import SparkSession

OPEN, CLOSED = "open", "closed"
# Manifests that are kept: a stream replays its last batch only.
KEPT = 256


@dataclass(frozen=True)
class Manifest:
    """One batch: its ids, and what the store consists of once it is closed."""

    batch: int = 0
    key: str = ""
    state: str = CLOSED
    started_at: str = ""
    # Ids of this batch: last_id is that of the store too, as ids run on.
    first_id: int = 1
    last_id: int = 0
    new_articles: dict = field(default_factory=dict)
    # The hash index: sorted runs and the hashes of single batches since.
    runs: list = field(default_factory=list)
    recent: list = field(default_factory=list)
    # Counts up to this batch stand in one table, those since in one table a batch.
    counts_base: int = 0

    @property
    def articles(self) -> int:
        return self.last_id - self.first_id + 1


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, at = _at(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(content))
    out.close()


class Batches:
    """The manifests of a store, one file a batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _names(self) -> list[tuple[int, str, str]]:
        """(batch, hash of the key, state) of all manifests, from one listing."""
        fs, at = _at(self.spark, self.folder)
        if not fs.exists(at):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(at)]
        found = [re.fullmatch(r"(\d{12})-([0-9a-f]{32})\.(open|closed)", n) for n in names]
        return sorted((int(m[1]), m[2], m[3]) for m in found if m)

    def _path(self, batch: int, key: str, state: str) -> str:
        return f"{self.folder}/{batch:012d}-{key}.{state}"

    def _read(self, batch: int, key: str, state: str) -> Manifest:
        text = read_text(self.spark, self._path(batch, key, state))
        return Manifest(**json.loads(text))

    def _write(self, manifest: Manifest) -> None:
        target = self._path(manifest.batch, md5(manifest.key.encode()).hexdigest(), manifest.state)
        write_bytes(self.spark, f"{target}.tmp", json.dumps(asdict(manifest)).encode())
        fs, at = _at(self.spark, f"{target}.tmp")
        _, final = _at(self.spark, target)
        # A file under its final name is whole.
        fs.delete(final, False)
        if not fs.rename(at, final):
            raise OSError(f"could not write {target}")

    def last(self) -> Manifest:
        """The last closed batch, which says what the store consists of."""
        closed = [n for n in self._names() if n[2] == CLOSED]
        return self._read(*closed[-1]) if closed else Manifest()

    def all(self) -> list[Manifest]:
        return [self._read(*n) for n in self._names()]

    def closed(self, key: str) -> Manifest | None:
        """The closed batch of this key, if there is one."""
        name = md5(key.encode()).hexdigest()
        found = [n for n in self._names() if n[1:] == (name, CLOSED)]
        return self._read(*found[-1]) if found else None

    def open(self, manifest: Manifest) -> None:
        # What broke off before goes; this batch takes its number.
        for n, key, state in self._names():
            if state == OPEN:
                remove(self.spark, self._path(n, key, state))
        self._write(replace(manifest, state=OPEN))

    def close(self, manifest: Manifest) -> None:
        self._write(replace(manifest, state=CLOSED))
        for n, key, state in self._names():
            if state == OPEN or n <= manifest.batch - KEPT:
                remove(self.spark, self._path(n, key, state))
