"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import save_table  # noqa: F401  (used by the operators)

#: Rows of an Arrow batch that goes to a Python worker; long texts make larger batches costly.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def drop_saved(table: DataFrame) -> None:
    """Delete a table that ``save_table`` wrote and that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """0 to 3: crc32 of the id as text, modulo 4 (2 is held out from training)."""
    return F.crc32(doc_id.cast("string")) % 4


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts of a batch as UTF-8 bytes, one at a time; null is empty."""
    for x in batch.column(batch.schema.get_field_index(name)):
        yield (x.as_buffer().to_pybytes() if x.is_valid else b"") or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word bytes to a 64-bit hash; remembers a bounded number of words of a bounded length."""

    LIMIT, LONGEST = 300_000, 64

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The word hashes of a worker process, one table for all operators that run in it.
WORDS = WordHash()


def split_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six bytes."""
    return text.split()


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles, in order of their first words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = word_hashes[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word_hashes[i:i + n]
    return mix64(h)
