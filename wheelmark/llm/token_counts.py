"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are aggregated by encoded length; suffix sums over the lengths then answer, for any context limit, how many
documents reach it, how many tokens they have, how many remain when each is cut there, and any quantile. The sums are
made in two steps, over blocks of lengths and inside each block, so that no task takes all lengths.

Cases: null and empty texts have length 0; ties and repeated rows count as often as they occur; other columns are
ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.llm.bpe import batches_of_texts, codec, shipped
from wheelmark.llm.shared import picked, written

#: Lengths in a block.
BLOCK = 1024


def lengths(docs: DataFrame, ranks: dict[bytes, int], text_col: str = "text") -> DataFrame:
    """``n_tokens``, ``n_docs``: partial counts, one row for each length and batch."""
    name, shipped_ranks = shipped(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, shipped_ranks)
        for batch in batches:
            counts: dict[int, int] = {}
            for _, texts in batches_of_texts(batch):
                for coded in own.encode(texts):
                    n = coded.count(" ")
                    counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["n_tokens", "n_docs"])
        own.rest()

    rows = picked(docs, text=text_col).select(F.lit(None).cast("int").alias("id"), "text")
    return rows.mapInArrow(run, "n_tokens bigint, n_docs bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs, and over all documents

    docs_below, tokens_below (of shorter documents), docs_from, tokens_from (of documents at least as long),
    truncated_total (tokens left where each document is cut at n_tokens) and quantile (share of documents no longer).
    """
    # Written once: three branches read the counts, and encoding must not run for each of them.
    counts = written(lengths.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    totals = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    later = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(every).alias("all_docs"),
        F.sum("tokens").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(later, "block")
        .withColumn("docs_from", F.col("docs_later") + F.sum("n_docs").over(inside))
        .withColumn("tokens_from", F.col("tokens_later") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside))
        .select(
            "n_tokens",
            "n_docs",
            (F.col("all_docs") - F.col("docs_from")).alias("docs_below"),
            (F.col("all_tokens") - F.col("tokens_from")).alias("tokens_below"),
            "docs_from",
            "tokens_from",
            (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        )
    )


def truncated_totals(hist: DataFrame, limits: DataFrame, limit_col: str = "context_limit") -> DataFrame:
    """For each limit (others than whole numbers from 0 give no row): n_docs, total_tokens, truncated_tokens, n_truncated, tokens_lost."""
    asked = written(limits.select(F.col(limit_col).cast("bigint").alias("n_tokens")).where("n_tokens >= 0").distinct(), "limits")
    # A limit is a length that no document has: its sums are then in the histogram, whatever lengths occur.
    both = histogram(hist.select("n_tokens", "n_docs").unionByName(asked.withColumn("n_docs", F.lit(0).cast("bigint"))))
    total = F.col("tokens_below") + F.col("tokens_from")
    return both.join(asked, "n_tokens").select(
        F.col("n_tokens").alias(limit_col),
        (F.col("docs_below") + F.col("docs_from")).alias("n_docs"),
        total.alias("total_tokens"),
        F.col("truncated_total").alias("truncated_tokens"),
        (F.col("docs_from") - F.col("n_docs")).alias("n_truncated"),
        (total - F.col("truncated_total")).alias("tokens_lost"),
    )


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The least length such that at least a share ``q`` of the documents is no longer."""
    return hist.where(F.col("quantile") >= q - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
