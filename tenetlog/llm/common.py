"""What the operators of this folder share: inputs, scratch tables, words and hashes of text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenetlog.session import configure, scratch_path

WORD_BREAKS = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 2_000_000   # text handled at once by numpy code; one longer document makes a chunk of its own


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings for text work: small Arrow batches bound the memory of Python workers."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.parquet.compression.codec", "snappy")      # these figures were taken with it
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators read, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here and survives lost executors.

    The folder goes when the driver's JVM ends; ``drop_stored`` removes it earlier.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_rng = np.random.default_rng(20240611)
_BYTE_VALUE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE_VALUE[list(WORD_BREAKS)] = 0
_BASE = np.uint64(int(_rng.integers(1, 2**62)) * 4 + 3)
_GRAM = np.uint64(int(_rng.integers(1, 2**62)) * 4 + 1)
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(WORD_BREAKS)] = True


class Words:
    """Words of some documents: byte spans in one buffer, 64-bit hashes, and each document's word range."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))   # first byte of each text, and the end
        gap = _IS_BREAK[raw]
        inside = ~gap
        before = np.empty_like(gap)
        before[0], before[1:] = True, gap[:-1]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(gap & ~before)
        if len(gap) and gap[0]:
            self.ends = self.ends[self.ends > 0]
        self.ranges = np.searchsorted(self.starts, self.offsets)     # first word of each text, and the end
        if hashed:
            self.hashes = self._hash(raw)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        length = self.ends - self.starts
        power = np.ones(int(length.max()) + 1, np.uint64)
        np.cumprod(np.full(len(power) - 1, _BASE, np.uint64), out=power[1:])
        span = np.diff(np.append(self.starts, len(raw)))             # up to the next word
        place = np.arange(int(self.starts[0]), len(raw)) - np.repeat(self.starts, span)
        np.minimum(place, len(power) - 1, out=place)
        value = _BYTE_VALUE[raw[int(self.starts[0]):]] * power[place]
        total = np.add.reduceat(value, self.starts - self.starts[0])
        return mixed(total + length.astype(np.uint64) * _GRAM)

    def __len__(self) -> int:
        return len(self.ranges) - 1

    def words_of(self, k: int) -> list[bytes]:
        return self.buffer[self.offsets[k]:self.offsets[k + 1]].split()


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (runs may cross documents; callers cut them)."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out = out * _GRAM + hashes[k:k + count]
    return mixed(out)


MAP_BITS = 24            # a bit map has 2 ** MAP_BITS bits: 2 MB, however many hashes it holds


def bit_map(hashes: DataFrame) -> np.ndarray:
    """Both bits of every 64-bit ``hash``, packed; the driver receives at most 2 ** MAP_BITS / 64 rows.

    The more hashes it holds the more others pass as well, so what follows must not rely on it.
    """
    low = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    high = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    rows = (hashes.select(F.explode(F.array(low, high)).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas())
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_map(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a map of ``bit_map``."""
    def held(bits):
        return (packed[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) == 1

    found = held((hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64))
    at = np.flatnonzero(found)
    found[at] = held((hashes[at] & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64))
    return found


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(batches, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of about ``limit`` bytes each, from Arrow batches of (doc_id, text)."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
            if ids and size + len(raw) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield ids, texts
