"""A streaming form of the cumulative-sum detector: state for each series, watermark for late samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wheelmark.functions.tables import shared_folder

OUT = "series bigint, alarm_ts timestamp, arm string, n bigint, level double"
STATE = "n bigint, mean double, m2 double, hi double, lo double, alarmed boolean"


def detect(samples: DataFrame, k: float = 0.5, h: float = 5.0, settle: int = 8, lateness: str = "1 hour", idle_s: int = 7 * 86_400) -> DataFrame:
    """First alarm of each series of a stream (series, ts, value): sums over values standardised by what came before.

    Samples later than ``lateness`` are dropped by the watermark. A trigger's samples are taken in the order of time;
    between triggers they count as they come. State is six numbers a series, and goes when the watermark has passed a
    series' last sample by ``idle_s`` seconds: a series that comes back after that begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2, hi, lo, alarmed = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for ts, x in rows[["ts", "value"]].itertuples(index=False):
            if alarmed or pd.isna(x):
                continue
            if n >= settle and m2 > 0:
                z = (x - mean) / (m2 / n) ** 0.5
                hi, lo = max(0.0, hi + z - k), min(0.0, lo + z + k)
                if hi > h or lo < -h:
                    alarmed = True
                    out.append((key[0], ts, "hi" if hi > h else "lo", n, hi if hi > h else lo))
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
        state.update((n, mean, m2, hi, lo, alarmed))
        last = 0 if rows.ts.isna().all() else int(rows.ts.max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * idle_s)
        yield pd.DataFrame(out, columns=["series", "alarm_ts", "arm", "n", "level"])

    late = samples.withWatermark("ts", lateness)
    return late.groupBy("series").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(samples: DataFrame, gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Samples of each series and session: sessions end after ``gap`` without samples."""
    return samples.withWatermark("ts", lateness).groupBy("series", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that ends with the table: first alarm of each user's values."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    samples = stream.select(F.col("user_id").cast("bigint").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value")
    run = f"{shared_folder(spark)}/cusum-{uuid.uuid4().hex}"
    writer = detect(samples).writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    writer.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{run}/out")
