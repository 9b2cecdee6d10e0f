"""Exact dedup with a log-structured merge index.

Each task keeps a memtable of digests. A full one is flushed as runs, one for each shard (the digest's first bits): sorted
digests with an identifier and a number of rows each, and a Bloom filter. Compaction merges a shard's sorted runs into
one, keeping the smallest (or largest) identifier and adding the numbers up. Rows whose digest passes the filters over
what was met more than once are hits; only hits carry their text further, and equal bytes are confirmed by grouping the
hits on digest and text, which combines copies before the shuffle. More tables can be inserted later; ``known`` asks the
runs' filters first and looks up what passes.

Cases: null texts count as empty, so that all null and empty texts are copies of each other; a null id never stays
beside a row that has one; rows that share the id that stays (repeated rows, ties) are one document and all stay; rows
that share an id but not the text are judged each by its own text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelmark.llm.shared import ASCII_LOWER, BROADCAST_BYTES, bits_within, bloom, bloom_has, field, join_hot, picked, pieces, shared_dir, written

#: Digests in a memtable before it is flushed, and rows of a table for each shard.
MEMTABLE, SHARD = 100_000, 100_000


def normalised(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text in UTF-8 with A-Z in lower case; null counts as empty."""
    low, at = data.tobytes().translate(ASCII_LOWER), offsets.tolist()
    return [low[x:y] for x, y in zip(at, at[1:], strict=False)]


def keys_of(digests: list[bytes]) -> np.ndarray:
    """Two integers of each digest, which are as well mixed as it is."""
    return np.frombuffer(b"".join(x[:16].ljust(16, b"\0") for x in digests), np.uint64).reshape(-1, 2)


def run_row(shard: int, entries: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """A run as a row: entries are (digest, identifier, number), sorted."""
    digests, ids, counts = (list(x) for x in zip(*entries, strict=True))
    columns = [pa.array([shard], pa.int32()), pa.array([b"".join(digests)], pa.binary()), pa.array([ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([bloom(keys_of(digests))], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "digests", "ids", "counts", "filter"])


class LsmIndex:
    """An index of digests in the shared folder; ``keep`` is "largest" or "smallest" identifier."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", digest_bytes: int = 32) -> None:
        if keep not in ("largest", "smallest"):
            raise ValueError("keep: largest or smallest")
        self.spark, self.keep, self.digest_bytes = spark, keep, digest_bytes
        self.runs: list[str] = []
        self.bits: int | None = None
        self.compacted = False

    def best(self, column: str):
        return F.max(column) if self.keep == "largest" else F.min(column)

    def _digest(self):
        size = self.digest_bytes
        return lambda text: hashlib.sha256(text).digest()[:size]

    def _shard(self):
        """A digest's first bits, as an integer."""
        bits = self.bits
        return lambda digest: int.from_bytes(digest[:4].ljust(4, b"\0"), "big") >> (32 - bits)

    def _layout(self) -> str:
        return f"shard int, digests binary, ids array<{self.id_type}>, counts array<bigint>, filter binary"

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LsmIndex:
        """Memtables: one run or more from each task and shard. The first table's rows decide on the number of shards."""
        rows, best, digest = picked(docs, id=id_col, text=text_col), max if self.keep == "largest" else min, self._digest()
        if self.bits is None:
            self.bits = min(max(0, (rows.count() // SHARD).bit_length()), 24, 8 * self.digest_bytes)
        self.id_type, self.text_type = field(rows, "id"), field(rows, "text")
        shard = self._shard()

        def flush(table: dict[bytes, list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            own: dict[int, list[tuple]] = {}
            for d in sorted(table):
                own.setdefault(shard(d), []).append((d, *table[d]))
            for s, entries in own.items():
                yield run_row(s, entries, kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table: dict[bytes, list] = {}
            kind = None
            for data, offsets, batch in pieces(batches):
                kind = batch.schema.field("id").type
                for key, text in zip(batch["id"].to_pylist(), normalised(data, offsets), strict=True):
                    held = table.setdefault(digest(text), [None, 0])
                    if key is not None:
                        held[0] = key if held[0] is None else best(held[0], key)
                    held[1] += 1
                if len(table) >= MEMTABLE:
                    yield from flush(table, kind)
                    table = {}
            if table:
                yield from flush(table, kind)

        path = shared_dir(self.spark, "runs")
        rows.mapInArrow(run, self._layout()).write.parquet(path)
        self.runs.append(path)
        self.compacted = False
        return self

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self._layout()).parquet(*self.runs)

    def compact(self) -> LsmIndex:
        """Merges each shard's sorted runs into one, which replaces them."""
        best, size = max if self.keep == "largest" else min, self.digest_bytes

        def merge(key, table):
            def entries(row: dict) -> Iterator[tuple]:
                for i, (own, n) in enumerate(zip(row["ids"], row["counts"], strict=True)):
                    yield row["digests"][size * i : size * (i + 1)], own, n

            merged: list[tuple] = []
            for digest, own, n in heapq.merge(*map(entries, table.to_pylist()), key=lambda x: x[0]):
                if merged and merged[-1][0] == digest:
                    _, held, many = merged[-1]
                    merged[-1] = digest, own if held is None else held if own is None else best(held, own), many + n
                else:
                    merged.append((digest, own, n))
            return pa.Table.from_batches([run_row(key[0].as_py(), merged, table.schema.field("ids").type.value_type)])

        path = shared_dir(self.spark, "level")
        self._table().groupBy("shard").applyInArrow(merge, self._layout()).write.parquet(path)
        self.runs, self.compacted = [path], True
        return self

    def entries(self, least: int = 1) -> DataFrame:
        """digest, id, n of the compacted index, where n is at least ``least``."""
        if not self.compacted:
            self.compact()
        size = self.digest_bytes

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.schema.field("ids").type.value_type
                for row in batch.to_pylist():
                    some = [i for i, n in enumerate(row["counts"]) if n >= least]
                    yield pa.RecordBatch.from_arrays([pa.array([row["digests"][size * i : size * (i + 1)] for i in some], pa.binary()), pa.array([row["ids"][i] for i in some], kind), pa.array([row["counts"][i] for i in some], pa.int64())], names=["digest", "id", "n"])

        return self._table().mapInArrow(unpack, f"digest binary, id {self.id_type}, n bigint")

    def repeated_filters(self) -> dict[int, bytes]:
        """By shard, a filter over the digests that were met more than once; BROADCAST_BYTES in all at most."""
        n = self._table().select(F.sum(F.size(F.filter("counts", lambda c: c > 1)))).first()[0] or 0
        size, bits = self.digest_bytes, bits_within(n)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = [row["digests"][size * i : size * (i + 1)] for i, c in enumerate(row["counts"]) if c > 1]
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([bloom(keys_of(own), bits)], pa.binary())], names=["shard", "filter"])

        made = self._table().select("shard", "digests", "counts").mapInArrow(build, "shard int, filter binary")
        return {r.shard: bytes(r.filter) for r in made.collect()}

    def _passing(self, filters: dict[int, list[bytes]]):
        """Which of some digests pass a filter of their shard; to be called in tasks."""
        sent, shard = self.spark.sparkContext.broadcast(filters), self._shard()

        def test(digests: list[bytes]) -> np.ndarray:
            out = np.zeros(len(digests), bool)
            of = np.array([shard(d) for d in digests], np.int64)
            for s in np.unique(of).tolist():
                mine = np.flatnonzero(of == s)
                keys = keys_of([digests[i] for i in mine.tolist()])
                for f in sent.value.get(s, ()):
                    out[mine] |= bloom_has(f, keys)
            return out

        return test

    def probe(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """id, digest, text_sha256, the normalised text of hits (null for others), and ``carry`` as c0, c1 and so on."""
        if not self.compacted:
            self.compact()
        held = {f"c{i}": c for i, c in enumerate(carry)}
        rows, digest = picked(docs, id=id_col, text=text_col, **held), self._digest()
        passing = self._passing({s: [f] for s, f in self.repeated_filters().items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data, offsets, batch in pieces(batches):
                texts = normalised(data, offsets)
                digests = list(map(digest, texts))
                hit = passing(digests).tolist()
                columns = [batch["id"], pa.array(digests, pa.binary()), pa.array([x if h else None for x, h in zip(texts, hit, strict=True)], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(batch[c] for c in held)], names=["id", "digest", "body", "text_sha256", *held])

        return rows.mapInArrow(run, f"id {field(rows, 'id')}, digest binary, body binary, text_sha256 string" + "".join(f", {c} {field(rows, c)}" for c in held))

    def known(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id`` and known_id (the index's identifier for the same digest, null where it has none); nothing is inserted.

        The runs' filters keep back what cannot be there, where they are small enough to be broadcast; what passes is
        looked up by digest. Bytes are not verified: texts of what was inserted are not in the index.
        """
        rows, digest = picked(docs, id=id_col, text=text_col), self._digest()
        size = self._table().select(F.sum(F.octet_length("filter"))).first()[0] or 0
        filters: dict[int, list[bytes]] = {}
        if size <= BROADCAST_BYTES:
            for r in self._table().select("shard", "filter").collect():
                filters.setdefault(r.shard, []).append(bytes(r.filter))
        passing = self._passing(filters) if size <= BROADCAST_BYTES else lambda digests: np.ones(len(digests), bool)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data, offsets, batch in pieces(batches):
                digests = list(map(digest, normalised(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array([d if ok else None for d, ok in zip(digests, passing(digests).tolist(), strict=True)], pa.binary())], names=["id", "digest"])

        asked = written(rows.mapInArrow(run, f"id {field(rows, 'id')}, digest binary"), "asked")
        found = self.entries().select("digest", F.col("id").alias("known_id"))
        hits = asked.where("digest is not null").join(found, "digest", "left").select("id", "known_id")
        misses = asked.where("digest is null").select("id", F.lit(None).cast(self.id_type).alias("known_id"))
        return hits.unionByName(misses).withColumnRenamed("id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest_bytes: int = 32, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, keep_id, group_size, kept, text_sha256, and the columns named in ``carry``: one row for each of ``docs``."""
    spark = docs.sparkSession
    index = LsmIndex(spark, keep, digest_bytes).insert(docs, id_col, text_col).compact()
    repeated = written(index.entries(least=2), "repeated")
    probes = written(index.probe(docs, id_col, text_col, carry), "probes")
    own = {f"c{i}": c for i, c in enumerate(carry)}
    # Byte verification: the digest's rows are copies of each other if one text alone stands behind it.
    texts = probes.where("body is not null").groupBy("digest", "body").agg(index.best("id").alias("own_id"), F.count("*").alias("own_n"))
    texts = written(texts, "texts")
    verified = repeated.join(texts.groupBy("digest").agg(F.count("*").alias("texts")), "digest").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), "texts")
    verified = written(verified, "verified")
    clashing = verified.where("texts > 1").select("digest")
    if clashing.isEmpty():
        one = join_hot(probes.drop("body"), verified, "digest", "group_size")
        rows = one.select("id", F.when(F.col("texts").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256", *own)
    else:  # one digest, several texts: those are told apart by their bytes
        apart = texts.join(clashing, "digest", "left_semi")
        rows = join_hot(probes, verified.drop("texts"), "digest", "group_size").join(apart, ["digest", "body"], "left").select(
            "id",
            F.when(F.col("own_n").isNotNull(), F.col("own_id")).when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("own_n", "group_size", F.lit(1)).cast("bigint").alias("group_size"),
            "text_sha256",
            *own,
        )
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *[F.col(c).alias(name) for c, name in own.items()])
