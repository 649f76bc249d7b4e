"""Small helpers shared by the operators: shared scratch tables, Arrow text buffers, vectorised hashing.

Conventions of every operator in this subpackage: a null text counts as the empty text; only the
columns named by the caller are read, so further columns with any names do no harm; an empty table
gives an empty result with the same schema; a row that appears twice is two rows unless the
operator's docstring says otherwise.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z and leaves every other byte alone.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32
#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once inside a task; a longer document stands alone.
BLOCK_BYTES = 1 << 20

_MULT, _MULT2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local
    session gets a new temporary folder, set for the session; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and read it back. It cuts the lineage
    and outlives executors, so a lost executor costs the tasks that ran on it and nothing before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Null to empty, A-Z to a-z, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


# ---------------------------------------------------------------------------------------------
# Bitmaps of keys
#: Bits of a bitmap for each key, and the most bits of one (8 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 26


def marks(keys: DataFrame, *on: str) -> tuple[DataFrame, int]:
    """A bitmap with the bits of the hashes of ``keys`` (a written table) set, as rows of 4 KB, and its number of
    bits: BITS_PER_KEY for each key, MOST_BITS at most."""
    bits = min(MOST_BITS, 1 << max(15, (BITS_PER_KEY * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")), bits


def marked(rows: DataFrame, bitmap: tuple[DataFrame, int], *on: str) -> DataFrame:
    """``rows`` with the boolean ``marked``: false for a key that is surely not among those of ``bitmap``, so
    that an exact join need not shuffle the row. The broadcast is 8 MB at most, whatever the input; a
    fuller bitmap only marks more rows. ``rows`` has no columns named bucket, bits or marked."""
    table, bits = bitmap
    slot = F.pmod(F.xxhash64(*on), F.lit(bits))
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    return rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(table), "bucket", "left").withColumn("marked", hit).drop("bucket", "bits")


# ---------------------------------------------------------------------------------------------
# Arrow buffers
def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the n + 1 offsets of its rows, without copying."""
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if large else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(arr: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of whole rows of about ``limit`` bytes."""
    data, off = utf8(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, stops: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and for each row the index of its first word
    (n + 1 values). A word is a run of bytes that are not in ``stops`` within one row."""
    n = len(data)
    inside = ~stops[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


_powers: dict[str, np.ndarray] = {}


def _power(n: int, which: str, base: np.uint64) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        full[0] = 1
        have = _powers[which] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (fixed values)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Spans of more bytes are hashed by hashlib: for long ones, sums of powers modulo 2**64 can agree for different
#: spans whatever the multiplier.
LONG_SPAN = 64


class SpanHash:
    """64-bit hashes of any spans of a block: short ones in constant time from one running sum, those of more than
    LONG_SPAN bytes one by one. ``salt`` 0 and 1 give two independent hashes."""

    def __init__(self, data: np.ndarray, salt: int = 0) -> None:
        base = (_MULT, _MULT2)[salt]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        n = len(data)
        self.data, self.salt = data, bytes([salt])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(n, f"p{salt}", base), out=self.sums[1:])
        self.back = _power(n + 1, f"i{salt}", inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix((self.sums[end] - self.sums[start]) * self.back[start] + size.astype(np.uint64))
        long = np.flatnonzero(size > LONG_SPAN)
        if len(long):
            raw = np.ascontiguousarray(self.data)
            digests = (hashlib.blake2b(raw[a:b], digest_size=8, key=self.salt).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True))
            out[long] = np.frombuffer(b"".join(digests), np.uint64)
        return out


def shingles(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each row, and the index of each row's first one.
    A row with fewer words (but one at least) has one shingle of all its words."""
    n, counts = len(word_hash), np.diff(first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1], per) + np.repeat(first[:-1], per)
    last = np.repeat(first[1:], per)
    h = np.zeros(len(at), np.uint64)
    factor = np.uint64(0xA24BAED4963EE407)
    for k in range(size):
        p = at + k
        ok = p < last
        w = np.where(ok, word_hash[np.minimum(p, max(n - 1, 0))] if n else 0, np.uint64(0)).astype(np.uint64)
        h = h * factor + w
    return mix(h), out_first


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``first``; empty segments give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
