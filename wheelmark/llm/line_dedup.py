"""Line dedup that can be undone: exact reference counts, with sharded cuckoo filters in front of them.

The reference table holds, for each line key, in how many documents it is and the largest of them. A log of postings
(key, document, +1 or -1) stands behind it, so that a deletion restores what an insertion changed. A change works out the
counts of the keys that it touches and writes those only; the latest of a key's versions counts. Keys that are in at
least ``least_docs`` documents are common; each shard's common keys are in a cuckoo filter, which takes insertions and
deletions too and is made anew from the exact table where it is full. A line that passes its filter is looked up among
the exact keys.

Cases: a null or empty text is one empty line; a line's key is the line without white space at both ends, A-Z in lower
case; a key is counted once for each row however often the row holds it; a null id is smaller than any other; rows that
share the largest id all keep their lines; deleting rows that were not inserted raises ValueError and changes nothing; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelmark.llm.shared import ASCII_LOWER, BROADCAST_BYTES, field, picked, pieces, shared_dir, written

BLANKS = b" \t\n\x0b\x0c\r"
#: Keys in a filter's shard, at most about.
SHARD = 500_000
#: Versions of the reference table that are read together before they are made one.
VERSIONS = 8


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(ASCII_LOWER)


def key_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def keyed(line: bytes, least: int) -> bytes | None:
    """The hash of the line's key; None where it has fewer code points than ``least``."""
    if len(line) < least:
        return None
    key = line_key(line)
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key_hash(key)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class CuckooFilter:
    """Four 16-bit fingerprints in a bucket; a key has two buckets. ``insert`` says where the table is full; ``of`` doubles it."""

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int = 0, table: np.ndarray | None = None) -> None:
        size = 1
        while size * self.SLOTS * 0.85 < keys:
            size *= 2
        self.table = np.zeros((size, self.SLOTS), np.uint16) if table is None else table.copy()

    @staticmethod
    def _split(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: (n, 2) uint64. Fingerprint (never 0) and first place."""
        return (keys[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16), keys[:, 0]

    def _other(self, place, print_):
        return (int(place) ^ (int(print_) * 0x5BD1E995)) & (len(self.table) - 1)

    def insert(self, key: np.ndarray) -> bool:
        (f,), (p,) = self._split(key.reshape(1, 2))
        f, at = int(f), int(p) & (len(self.table) - 1)
        rnd = f
        for place in (at, self._other(at, f)):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = f
                return True
        saved = self.table.copy()
        for _ in range(self.KICKS):
            rnd = (rnd * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (rnd >> 8) % self.SLOTS
            f, self.table[at, slot] = int(self.table[at, slot]), f
            at = self._other(at, f)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        self.table = saved
        return False

    def delete(self, key: np.ndarray) -> bool:
        (f,), (p,) = self._split(key.reshape(1, 2))
        at = int(p) & (len(self.table) - 1)
        for place in (at, self._other(at, f)):
            own = np.flatnonzero(self.table[place] == f)
            if len(own):
                self.table[place, own[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, p = self._split(keys)
        mask = len(self.table) - 1
        at = (p & np.uint64(mask)).astype(np.int64)
        other = (at ^ (f.astype(np.int64) * 0x5BD1E995)) & mask
        return (self.table[at] == f[:, None]).any(axis=1) | (self.table[other] == f[:, None]).any(axis=1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(4, len(keys))
        while True:
            out = cls(size)
            if all(out.insert(k) for k in keys):
                return out
            size *= 2

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS))


class LineIndex:
    """Reference counts of line keys in the shared folder, and filters over the common ones."""

    def __init__(self, spark: SparkSession, least_chars: int = 40, least_docs: int = 5) -> None:
        self.spark, self.least_chars, self.least_docs = spark, least_chars, least_docs
        self.postings: list[str] = []
        self.versions: list[DataFrame] = []
        self.filters: DataFrame | None = None
        self.shards = 1

    def _posted(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> str:
        """Writes the postings of ``docs``: key, id, n."""
        rows, least = picked(docs, id=id_col, text=text_col), self.least_chars
        self.id_type = field(rows, "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data, offsets, batch in pieces(batches):
                keys, of = [], []
                for i, text in enumerate(texts_of(data, offsets)):
                    own = {keyed(line, least) for line in text.split(b"\n")} - {None}
                    keys += own
                    of += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch["id"].take(pa.array(of, pa.int64())), pa.array(np.full(len(keys), sign, np.int64))], names=["key", "id", "n"])

        path = shared_dir(self.spark, "lines")
        rows.mapInArrow(run, f"key binary, id {self.id_type}, n bigint").write.parquet(path)
        return path

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        path = self._posted(docs, 1, id_col, text_col)
        batch = self.spark.read.parquet(path).groupBy("key").agg(F.sum("n").alias("docs"), F.max("id").alias("id"))
        if not self.versions:
            self.postings.append(path)
            self.versions = [written(batch.withColumn("version", F.lit(0)), "references")]
            return self._build()
        batch = written(batch, "batch")
        old = self.references().join(batch.select("key"), "key", "left_semi").select("key", F.col("docs").alias("old_docs"), F.col("id").alias("old_id"))
        both = batch.join(old, "key", "left")
        return self._changed(path, both.select("key", (F.col("docs") + F.coalesce("old_docs", F.lit(0))).alias("docs"), F.greatest("id", "old_id").alias("id"), F.coalesce("old_docs", F.lit(0)).alias("before")))

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Takes back what ``insert`` of the same rows added."""
        path = self._posted(docs, -1, id_col, text_col)
        touched = written(self.spark.read.parquet(path).select("key").distinct(), "touched")
        left = self.spark.read.parquet(*self.postings, path).join(touched, "key", "left_semi").groupBy("key", "id").agg(F.sum("n").alias("n"), F.sum(F.greatest("n", F.lit(0))).alias("inserted"))
        left = written(left, "left")
        if not left.where("n < 0").isEmpty():
            raise ValueError("rows to be deleted were not inserted")
        now = left.groupBy("key").agg(F.sum("n").alias("docs"), F.max(F.when(F.col("n") > 0, F.col("id"))).alias("id"))
        before = self.references().join(touched, "key", "left_semi").select("key", F.col("docs").alias("before"))
        return self._changed(path, now.join(before, "key", "left").withColumn("before", F.coalesce("before", F.lit(0))))

    def _changed(self, path: str, changed: DataFrame) -> LineIndex:
        """Takes over the new counts of the keys that a change touched (key, docs, id, before)."""
        changed = written(changed, "changed")
        if len(self.versions) >= VERSIONS:
            self.versions = [written(self.references().withColumn("version", F.lit(0)), "references")]
        self.postings.append(path)
        self.versions.append(changed.select("key", "docs", "id", F.lit(len(self.versions)).alias("version")))
        turn = F.when(F.col("docs") >= self.least_docs, 1).otherwise(0) - F.when(F.col("before") >= self.least_docs, 1).otherwise(0)
        return self._update(changed.select("key", turn.alias("turn")).where("turn != 0"))

    def references(self) -> DataFrame:
        """key, docs (in how many it is), id (the largest of them)."""
        if len(self.versions) == 1:
            return self.versions[0].where("docs > 0").select("key", "docs", "id")
        rows = self.versions[0]
        for more in self.versions[1:]:
            rows = rows.unionByName(more)
        return rows.groupBy("key").agg(F.max_by(F.struct("docs", "id"), "version").alias("last")).select("key", "last.*").where("docs > 0")

    def common(self) -> DataFrame:
        return self.references().where(F.col("docs") >= self.least_docs)

    def _shard(self):
        return F.pmod(F.conv(F.hex(F.substring("key", 1, 3)), 16, 10).cast("bigint"), F.lit(self.shards)).cast("int")

    def _made(self, common: DataFrame) -> DataFrame:
        """shard and filter over the keys of ``common``."""

        def make(key, table):
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([CuckooFilter.of(_pairs(table["key"].to_pylist())).dump()], pa.binary())})

        return common.select("key", self._shard().alias("shard")).groupBy("shard").applyInArrow(make, "shard int, filter binary")

    def _build(self) -> LineIndex:
        common = self.common()
        self.shards = max(1, -(-common.count() // SHARD))
        self.filters = written(self._made(common), "filters")
        return self

    def _update(self, turned: DataFrame) -> LineIndex:
        """Inserts into the shards' filters what has become common, and deletes what no longer is."""

        def make(key, old, new):
            filter_ = CuckooFilter.load(old["filter"][0].as_py()) if len(old) else CuckooFilter(64)
            keys, full = _pairs(new["key"].to_pylist()) if len(new) else [], False
            for k, t in zip(keys, new["turn"].to_pylist(), strict=True):
                full |= not (filter_.insert(k) if t > 0 else filter_.delete(k))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([None if full else filter_.dump()], pa.binary())})

        made = self.filters.groupBy("shard").cogroup(turned.withColumn("shard", self._shard()).groupBy("shard")).applyInArrow(make, "shard int, filter binary")
        made = written(made, "filters")
        full = [r.shard for r in made.where("filter is null").select("shard").collect()]  # one row for each shard
        if full:  # a full table grows from its exact keys
            made = written(made.where("filter is not null").unionByName(self._made(self.common().where(self._shard().isin(full)))), "filters")
        self.filters = made
        return self

    def passing(self):
        """Which keys may be common: a test to be called in tasks, or None where the filters are too large to be sent."""
        size = self.filters.select(F.sum(F.octet_length("filter"))).first()[0] or 0
        if size > BROADCAST_BYTES:
            return None
        shards, sent = self.shards, self.spark.sparkContext.broadcast({x.shard: bytes(x.filter) for x in self.filters.collect()})
        return lambda keys: passing(keys, shards, sent.value)


def _pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def passing(keys: list[bytes], shards: int, filters: dict[int, bytes]) -> np.ndarray:
    """Which of the keys pass their shard's filter."""
    out = np.zeros(len(keys), bool)
    if keys:
        pairs = _pairs(keys)
        shard = np.array([int.from_bytes(k[:3], "big") % shards for k in keys])
        for s in np.unique(shard).tolist():
            if s in filters:
                own = np.flatnonzero(shard == s)
                out[own] = CuckooFilter.load(filters[s]).contains(pairs[own])
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, texts: bool = True, most_bytes: int = BROADCAST_BYTES, index: LineIndex | None = None) -> DataFrame:
    """``id``, n_lines, n_dropped, kept_sha256 and, unless ``texts`` is false, kept_text: one row for each of ``docs``.

    By the counts of ``index``, which must hold ``docs`` (and may hold more), or else of an index of ``docs`` alone.
    Common keys of at most ``most_bytes`` go to the executors by broadcast. Beyond that only the filters do: documents
    without a line that passes are done at once, the others' keys are joined with the reference table, and these
    documents alone travel.
    """
    spark = docs.sparkSession
    if index is None:
        index = LineIndex(spark, least_chars, least_docs).insert(docs, id_col, text_col)
    least = index.least_chars
    common = written(index.common(), "common")
    n = common.count()
    rows = picked(docs, id=id_col, text=text_col)
    kind = field(rows, "id")
    test = index.passing()

    def split(found: list[bytes]) -> tuple[list[list[bytes]], list[list[bytes | None]]]:
        """Lines and, where one is long enough and passes the filter, its key's hash."""
        lines = [x.split(b"\n") for x in found]
        hashes = [[keyed(x, least) for x in own] for own in lines]
        if test is not None:
            flat = list({h for own in hashes for h in own if h})
            met = {h for h, ok in zip(flat, test(flat).tolist(), strict=True) if ok}
            hashes = [[h if h in met else None for h in own] for own in hashes]
        return lines, hashes

    def result(ids: pa.Array, lines: list[list[bytes]], drop: list[list[bool]]) -> pa.RecordBatch:
        kept = [b"\n".join([x for x, d in zip(own, gone, strict=True) if not d]) for own, gone in zip(lines, drop, strict=True)]
        columns = [ids, pa.array([len(x) for x in lines], pa.int64()), pa.array([sum(x) for x in drop], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["id", "n_lines", "n_dropped", "kept_sha256"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x.decode() for x in kept], pa.string())], names=[*names, "kept_text"]) if texts else pa.RecordBatch.from_arrays(columns, names=names)

    out = f"id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept_text string" * texts
    if n * 200 <= most_bytes:
        exact = spark.sparkContext.broadcast({bytes(x.key): x.id for x in common.select("key", "id").collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = exact.value
            for data, offsets, batch in pieces(batches):
                lines, hashes = split(texts_of(data, offsets))
                yield result(batch["id"], lines, [[h in held and held[h] != i for h in own] for i, own in zip(batch["id"].to_pylist(), hashes, strict=True)])

        return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            pairs = [(i, h) for i, own in enumerate(split(texts_of(data, offsets))[1]) for h in {h for h in own if h}]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([h for _, h in pairs], pa.binary())], names=["id", "key"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            lines, hashes = split(texts_of(data, offsets))
            own = [i for i, x in enumerate(hashes) if not any(x)]
            yield result(batch["id"].take(pa.array(own, pa.int64())), [lines[i] for i in own], [[False] * len(lines[i]) for i in own])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            yield batch.filter(pa.array([any(x) for x in split(texts_of(data, offsets))[1]], pa.bool_()))

    # A row asks for its keys under its id: rows that share an id lose the same keys.
    asked = rows.mapInArrow(ask, f"id {kind}, key binary").distinct()
    losing = asked.join(common.select("key", F.col("id").alias("keeps")), "key").where(~F.col("id").eqNullSafe(F.col("keeps")))
    losing = losing.groupBy(F.col("id").alias("loser")).agg(F.collect_set("key").alias("gone"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_gone = batch["gone"].to_pylist()
            at = 0
            for data, offsets, part in pieces([batch.select(["id", "text"])]):
                lines, hashes = split(texts_of(data, offsets))
                gone = [set(x or ()) for x in all_gone[at : at + len(part)]]
                at += len(part)
                yield result(part["id"], lines, [[h in g for h in own] for own, g in zip(hashes, gone, strict=True)])

    some = rows.mapInArrow(others, f"id {kind}, text {field(rows, 'text')}").join(losing, F.col("id").eqNullSafe(F.col("loser")), "left").select("id", "text", "gone").mapInArrow(drop, out)
    return rows.mapInArrow(plain, out).unionByName(some).withColumnRenamed("id", id_col)
