"""A corpus pipeline of five of the operators; each stage reads what the one before it wrote.

Rows are dropped one by one: a row whose id another row has too is judged by its own text. A row without an id is judged
like any other (see the operators for which row of a group stays).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelmark.llm import bpe, decontam, exact_dedup, minhash, quality
from wheelmark.llm.queries import vocabulary
from wheelmark.llm.shared import BROADCAST_BYTES, filter_over, written

#: About what a dropped row's id and hashes take in a broadcast.
ROW_BYTES = 100


def fresh(docs: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``docs`` has, whatever the case of its letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for k in range(n):
        name = f"row_key_{k}"
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(docs: DataFrame, decide: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """The rows of ``docs`` less those that ``decide`` (doc_id, kept and the columns that it is told to carry) drops;
    rows, not ids, are dropped.

    Rows that share an id are told apart by two hashes of the text (null as empty). Rows that have id and hashes in common
    have the same text, and share the decision. Dropped rows go to the tasks by broadcast while they are few. Beyond that
    a filter over them sorts out who may be among them, and only those rows travel; a key with very many rows is split
    by Spark's skew join.
    """
    text = F.coalesce("text", F.lit(""))
    first, second, *gone = fresh(docs, 5)
    rows = docs.withColumns({first: F.xxhash64(text), second: F.xxhash64(F.lit(1), text)})
    names = ["doc_id", first, second]
    dropped = written(decide(rows, (first, second)).where(~F.col("kept")).select(*names).distinct(), "dropped")
    n = dropped.count()
    away = dropped.select(*[F.col(c).alias(g) for c, g in zip(names, gone, strict=True)])
    same = F.col("doc_id").eqNullSafe(F.col(gone[0])) & (F.col(first) == F.col(gone[1])) & (F.col(second) == F.col(gone[2]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if n * ROW_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(away), same, "left_anti").select(*columns)
    may = filter_over(dropped, first)

    def part(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(may(batch[first].to_numpy(zero_copy_only=False)) == wanted))

        return rows.mapInArrow(run, rows.schema)

    return part(False).unionByName(part(True).join(away, same, "left_anti")).select(*columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, lambda rows, keys: quality.resample(rows, labels, carry=keys))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, lambda rows, keys: exact_dedup.exact_dedup(rows, keep="largest", carry=keys))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, lambda rows, keys: minhash.near_duplicates(rows, size=5, least=0.8, carry=keys))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, lambda rows, keys: decontam.decontaminate(rows, benchmark, carry=keys).withColumn("kept", ~F.col("contaminated")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(docs, bpe.read_ranks(spark, vocabulary()))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: Hashed n-gram models and their resampling are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
