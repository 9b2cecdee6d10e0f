"""Helpers that the operators share: the shared folder, Arrow text buffers, token hashes, Bloom filters, hot keys."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whatever is broadcast is measured first and stays below this; each operator has another way beyond it.
BROADCAST_BYTES = 64 << 20
#: Text bytes that a task holds as NumPy arrays at a time (a longer document is taken by itself).
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20

UPPER = bytes(range(65, 91))
ASCII_LOWER = bytes.maketrans(UPPER, UPPER.lower())
ASCII_LOWER_STR = {c: c + 32 for c in range(65, 91)}


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the session has no such setting, a local master (tests) gets a temporary folder; a cluster is refused, since
    each executor would write to its own disk. ``clear`` removes what the application has left.
    """
    return f"{_top(spark)}/{what}-{uuid.uuid4().hex}"


def _top(spark: SparkSession) -> str:
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/wheelmark/{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes this application's intermediate tables; DataFrames that were made from them can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_top(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def field(df: DataFrame, column: str) -> str:
    """``column``'s type, as a DDL string."""
    return df.schema[column].dataType.simpleString()


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that no other column of the input can clash.

    From here on the session's Arrow batches hold BATCH_BYTES at most (a larger row is a batch by itself), so that a
    table of long texts takes no more memory in a Python worker than one of short texts.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", df.sparkSession.conf.get(setting)) or 0) != BATCH_BYTES:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def text_key(text_col: str = "text"):
    """SHA-256 (hex) of the text with A-Z in lower case, null as empty: what tells rows apart that share an id."""
    return F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER.decode(), UPPER.lower().decode()), 256)


def join_hot(rows: DataFrame, facts: DataFrame, on: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row of fixed size for each ``on``; ``weight``: its number of rows).

    Keys that hold more than a thousandth of all rows go by broadcast: there are a thousand of them at most, whatever
    the input. The others go by shuffle, where none of them is large.
    """
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) > max(total // 1000, 1)
    cool, few = facts.where(~hot), [tuple(r) for r in facts.where(hot).collect()]
    if not few:
        return rows.join(facts, on, "left")
    names = [c for c in facts.columns if c != on]
    small = rows.sparkSession.createDataFrame(few, facts.schema)
    marked = rows.join(F.broadcast(small.select(on, F.struct(*names).alias("_hot"))), on, "left")
    away = marked.where("_hot is null").drop("_hot").join(cool, on, "left")
    here = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in names])
    return away.select(*rows.columns, *names).unionByName(here)


def join_rare(rows: DataFrame, facts: DataFrame, on: str, weight: str, fact_bytes: int) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row of about ``fact_bytes`` for each ``on``), which few rows have.

    By broadcast while they are few; beyond that a filter sorts out the rows that may have one, and only those travel
    (a key that many of them share by broadcast: see ``join_hot``).
    """
    if facts.count() * fact_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), on, "left")
    may = filter_over(facts.select(F.xxhash64(on).alias("h")), "h")
    hashed = rows.withColumn("_h", F.xxhash64(on))

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may(batch["_h"].to_numpy(zero_copy_only=False)) == wanted))

        return hashed.mapInArrow(run, hashed.schema).drop("_h")

    return join_hot(part(True), facts, on, weight).unionByName(part(False), allowMissingColumns=True)


# --- Arrow text -------------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes each, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Bytes, offsets and rows of the batches, in pieces of bounded size."""
    for batch in batches:
        data, offsets = utf8(batch[column])
        for a, b in chunks(offsets, most):
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.slice(a, b - a)


# --- token hashes -----------------------------------------------------------------------------------------------

#: Byte to class: 0 separates tokens, a token is a longest run of one class. Byte to byte: what is hashed.
LOWERED = np.frombuffer(bytes(range(256)).translate(ASCII_LOWER), np.uint8)
ALNUM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)], np.uint8)
NOT_SPACE = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)], np.uint8)
WORD_OR_MARK = np.where(ALNUM == 1, 1, np.where((NOT_SPACE == 1) & (np.arange(256) > 32), 2, 0)).astype(np.uint8)

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens in ``data`` and, for each row, the number of tokens before it (and in all)."""
    kind = classes[data]
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offsets)


#: Longer tokens are hashed one by one.
LONG_TOKEN = 256


def lanes(low: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros behind the end), as integers."""
    padded = np.zeros(len(low) + 8, np.uint8)
    padded[: len(low)] = low
    return np.ndarray((len(low) + 1,), "<u8", padded, strides=(1,))


def lane(eight: np.ndarray, starts: np.ndarray, lens: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th eight bytes of tokens that have so many; what is behind a token's end counts as 0."""
    left = np.minimum(lens - 8 * k, 8).astype(np.uint64)
    return eight[starts + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token's lower-cased (A-Z) bytes: eight bytes at a time, mixed in one after the other."""
    low = LOWERED[data]
    lens = ends - starts
    out = mixed(lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    eight, k = lanes(low), 0
    live = np.flatnonzero(lens <= LONG_TOKEN)
    while len(live):
        out[live] = mixed(out[live] * np.uint64(0x9E3779B97F4A7C15) ^ lane(eight, starts[live], lens[live], k))
        k += 1
        live = live[lens[live] > 8 * k]
    for i in np.flatnonzero(lens > LONG_TOKEN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """For each pair of tokens, whether their lower-cased (A-Z) bytes are equal."""
    low, low_other = LOWERED[data], LOWERED[other]
    lens = ends - starts
    out = lens == other_ends - other_starts
    a, b, k = lanes(low), lanes(low_other), 0
    live = np.flatnonzero(out & (lens <= LONG_TOKEN))
    while len(live):
        same = lane(a, starts[live], lens[live], k) == lane(b, other_starts[live], lens[live], k)
        out[live] = same
        k += 1
        live = live[same & (lens[live] > 8 * k)]
    for i in np.flatnonzero(out & (lens > LONG_TOKEN)).tolist():
        out[i] = np.array_equal(low[starts[i] : ends[i]], low_other[other_starts[i] : other_ends[i]])
    return out


# --- Bloom filters ----------------------------------------------------------------------------------------------

#: Keys in a shard of a filter, about.
FILTER_SHARD = 500_000


def _bits(keys: np.ndarray, size: int, k: int) -> np.ndarray:
    """keys: (n, 2) uint64, already well mixed."""
    step = keys[:, 1] | np.uint64(1)
    return (keys[:, :1] + np.arange(k, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def bloom(keys: np.ndarray, bits_per_key: float = 12) -> bytes:
    """The number of hash functions in one byte, and the bits."""
    k = max(1, round(bits_per_key * 0.6))
    size = max(64, int(bits_per_key * len(keys)) + 7 & ~7)
    flags = np.zeros(size, np.uint8)
    flags[_bits(keys, size, k).ravel().astype(np.int64)] = 1
    return bytes([k]) + np.packbits(flags, bitorder="little").tobytes()


def bloom_has(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    table = np.frombuffer(filter_, np.uint8)[1:]
    at = _bits(keys, len(table) * 8, filter_[0])
    return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def bits_within(n: int) -> float:
    """Bits for each of ``n`` keys in filters of BROADCAST_BYTES at most: with more keys more passes, step by step."""
    return min(12.0, BROADCAST_BYTES * 8 / max(n, 1))


def filter_over(keys: DataFrame, column: str = "h") -> Callable[[np.ndarray], np.ndarray]:
    """A test (to be called in tasks) whether 64-bit hashes may be among those in ``keys``; broadcast, of bounded size."""
    n = keys.count()
    shards, bits = max(1, -(-n // FILTER_SHARD)), bits_within(n)

    def build(key, table):
        h = table["h"].to_numpy().view(np.uint64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([bloom(np.stack([mixed(h), mixed(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1), bits)], pa.binary())})

    own = keys.select(F.col(column).alias("h"))
    made = own.select("h", F.pmod("h", F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInArrow(build, "shard int, filter binary").collect()
    sent = keys.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in made})

    def has(h: np.ndarray) -> np.ndarray:
        shard, out = np.mod(h, shards), np.zeros(len(h), bool)
        h = h.view(np.uint64)
        pairs = np.stack([mixed(h), mixed(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        for s in np.unique(shard).tolist():
            if s in sent.value:
                mine = shard == s
                out[mine] = bloom_has(sent.value[s], pairs[mine])
        return out

    return has


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
