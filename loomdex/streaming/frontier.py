"""The frontier as Structured Streaming: first-wins deduplication, rate limits and delayed retries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CONFIG
from ..functions import url
from ..session import shared_dir, ship_package


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A table, one file or a folder of files, as a stream of its files."""
    ship_package(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # as a pattern the path may be a single file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder, and read that table."""
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def unseen(jobs: DataFrame, within: str | None = None) -> DataFrame:
    """The first job of each normalized URL; the others never come out.

    ``within`` bounds the state: copies later than that after the first (by ``enqueued_at``) may come out again.
    """
    n = jobs.withColumn("normalized", url.normalize(F.col("url"))).where("normalized IS NOT NULL")
    if within is None:
        return n.dropDuplicates(["normalized"])
    n = n.withColumn("at", F.timestamp_millis("enqueued_at")).withWatermark("at", within)
    return n.dropDuplicatesWithinWatermark(["normalized"])


def _sorted(frames: Iterable[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(by)


def take_tokens(at_ms: Iterable[int], tokens: float, last: int | None, rate: float, capacity: float) -> tuple[list[bool], float, int | None]:
    """Token bucket over times in order: who passes, and the bucket afterwards."""
    out = []
    for t in at_ms:
        tokens = capacity if last is None else min(capacity, tokens + max(0, t - last) * rate / 1000)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= out[-1]
    return out, tokens, last


def token_bucket(requests: DataFrame, key: str, at_ms: str, rate: float | None = None, capacity: float | None = None) -> DataFrame:
    """(key, at, passed) of each request (times BIGINT): a bucket of ``capacity`` tokens a key, refilled ``rate`` a second.

    Requests of a micro-batch are taken in order of time; the bucket is the key's state.
    """
    rate = float(CONFIG.global_rps if rate is None else rate)
    capacity = rate if capacity is None else capacity

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        d = _sorted(frames, ["at"])
        passed, tokens, last = take_tokens(d["at"].tolist(), tokens, last, rate, capacity)
        state.update((float(tokens), int(last)))
        yield pd.DataFrame({"key": k[0], "at": d["at"], "passed": passed})

    keyed = requests.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, at long, passed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def spaced(requests: DataFrame, key: str, at_ms: str, gap_ms: int | None = None) -> DataFrame:
    """(key, at, start): when each request may start so that a key's starts lie ``gap_ms`` apart."""
    gap = CONFIG.domain_delay_ms if gap_ms is None else gap_ms

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        starts, d = [], _sorted(frames, ["at"])
        for t in d["at"].tolist():
            starts.append(t if free is None else max(t, free))
            free = starts[-1] + gap
        state.update((int(free),))
        yield pd.DataFrame({"key": k[0], "at": d["at"], "start": starts})

    keyed = requests.select(F.col(key).cast("string").alias("key"), F.col(at_ms).cast("long").alias("at")).where("key IS NOT NULL AND at IS NOT NULL")
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, at long, start long", "free long", "append", GroupStateTimeout.NoTimeout)


def released_retries(retries: DataFrame, clock_ms: str = "enqueued_at", late: str = "1 hour") -> DataFrame:
    """Retries (url, due_at, ``clock_ms``) that come out once, when the stream's event time passes ``due_at``.

    The newest ``due_at`` of a URL counts; its state goes when it is released.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due = state.get[0]
            state.remove()
            yield pd.DataFrame({"url": [k[0]], "due_at": [due]})
            return
        due = max(int(f["due_at"].max()) for f in frames)
        due = max(due, state.get[0]) if state.exists else due
        if due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"url": [k[0]], "due_at": [due]})
            return
        state.update((due,))
        state.setTimeoutTimestamp(due)

    timed = retries.where("url IS NOT NULL AND due_at IS NOT NULL").select("url", "due_at", F.timestamp_millis(clock_ms).alias("at")).withWatermark("at", late)
    return timed.groupBy("url").applyInPandasWithState(step, "url string, due_at long", "due long", "append", GroupStateTimeout.EventTimeTimeout)
