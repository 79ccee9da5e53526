"""Requests per client in fixed windows, the windows over quota, and the requests to refuse as they arrive."""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Requests allowed per client and window.
PER_HOUR, PER_DAY = 50, 200
GRAINS = {"hour": "1 hour", "day": "1 day"}


def window_counts(events: DataFrame, key: str, ts: str, grain: str, watermark: str | None = None) -> DataFrame:
    """(client, grain, window_start, n); the same for a table and, with a watermark, for a stream."""
    stamped = events.select(F.col(key).alias("client"), F.col(ts).cast("timestamp").alias("at"))
    if watermark:
        stamped = stamped.withWatermark("at", watermark)
    counted = stamped.groupBy("client", F.window("at", GRAINS[grain])).agg(F.count("*").alias("n"))
    return counted.select("client", F.lit(grain).alias("grain"), F.col("window.start").alias("window_start"), "n")


def over_quota(events: DataFrame, key: str, ts: str, grain: str, limit: int, watermark: str | None = None) -> DataFrame:
    return window_counts(events, key, ts, grain, watermark).where(F.col("n") > limit)


def quota_violations(events: DataFrame, key: str, ts: str, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """Windows of a table in which a client sent more than its hourly or daily quota."""
    return over_quota(events, key, ts, "hour", per_hour).unionByName(over_quota(events, key, ts, "day", per_day))


def run_quota_stream(
    events: DataFrame,
    key: str,
    ts: str,
    grain: str,
    limit: int,
    sink: str,
    checkpoint: str,
    watermark: str = "1 hour",
    output_mode: str = "append",
) -> StreamingQuery:
    """Read what is there, then stop.

    ``append`` drops the state of windows that the watermark has closed and adds each of them to ``sink``
    once; windows still open are withheld. ``complete`` shows open windows too, but keeps the state of all
    windows for ever and rewrites ``sink`` with every result.
    """
    found = over_quota(events, key, ts, grain, limit, watermark)
    writer = found.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if output_mode == "append":
        return writer.format("parquet").start(sink)
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).start()


WIDTHS = {"hour_number": 3600, "day_number": 86400}
# What names a window of a client, in the state of a bucket.
NAMED = ["no_client", "client", "width", "start"]
ANSWERED = "no_client boolean, client bigint, no_id boolean, id bigint, at timestamp, hour_number bigint, day_number bigint"
# Clients are dealt to so many states. A call for each client takes far longer than its few requests; checkpoints hold to the number.
BUCKETS = 1024


def _numbered(events: DataFrame, key: str, ts: str, request: str) -> DataFrame:
    client, number = F.col(key).cast("bigint").alias("client"), F.col(request).cast("bigint").alias("id")
    return events.select(client, number, F.col(ts).cast("timestamp").alias("at"))


def _accepted(per_hour: int, per_day: int) -> Column:
    return (F.col("hour_number") <= per_hour) & (F.col("day_number") <= per_day)


def answer_requests(events: DataFrame, key: str, ts: str, request: str, per_hour: int = PER_HOUR, per_day: int = PER_DAY) -> DataFrame:
    """Every request of a table with its number in its client's hour and day, and whether both are within quota.

    Requests of one moment are numbered by id. Refused requests count like accepted ones.
    """
    place = lambda grain: F.row_number().over(W.partitionBy("client", F.date_trunc(grain, "at")).orderBy("at", "id")).cast("bigint")
    numbered = _numbered(events, key, ts, request).withColumns({"hour_number": place("hour"), "day_number": place("day")})
    return numbered.withColumn("accepted", _accepted(per_hour, per_day))


def _added(known: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of windows (rows of NAMED, then the count) after ``new`` ones came, and for each of these the count before."""
    both = np.concatenate([known, new])
    order = np.lexsort(both[:, :-1].T)  # stable: a known count stands before a new one of its window
    both = both[order]
    first = np.ones(len(both), dtype=bool)
    first[1:] = (both[1:, :-1] != both[:-1, :-1]).any(axis=1)
    again = np.flatnonzero(~first)
    before = np.zeros(len(both), dtype=np.int64)
    before[order[again]] = both[again - 1, -1]
    counts = both[first]
    counts[:, -1] = np.add.reduceat(both[:, -1], np.flatnonzero(first))
    return counts, before[len(known) :]


def _answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Numbers the requests of a bucket of clients as they come and keeps the counts of their windows that are still open."""
    known = np.empty((0, len(NAMED) + 1), dtype=np.int64)
    if state.exists:
        known = np.frombuffer(zlib.decompress(state.get[0]), dtype=np.int64).reshape(len(NAMED) + 1, -1).T
    if not state.hasTimedOut:
        requests = pd.concat(batches, ignore_index=True)
        # pandas keeps the wall clock of the session's zone, in which windows are cut
        micros = requests["at"].to_numpy("datetime64[us]").astype(np.int64)
        order = np.lexsort((requests["id"], requests["no_id"], micros, requests["client"], requests["no_client"]))
        requests, seconds = requests.iloc[order], micros[order] // 1_000_000
        numbers = {}
        for name, width in WIDTHS.items():
            window = np.column_stack([requests["no_client"], requests["client"], np.full(len(requests), width), seconds // width * width]).astype(np.int64)
            # the requests of a window stand together, as each client's are sorted by time
            first = np.flatnonzero(np.append(True, (window[1:] != window[:-1]).any(axis=1)))
            n = np.diff(np.append(first, len(window)))
            known, before = _added(known, np.column_stack([window[first], n]))
            numbers[name] = np.arange(1, len(window) + 1) + np.repeat(before - first, n)
        yield requests.drop(columns="bucket").assign(**numbers)
    closed = state.getCurrentWatermarkMs() // 1000
    ends = known[:, NAMED.index("width")] + known[:, NAMED.index("start")]
    known, ends = known[ends > closed], ends[ends > closed]
    if len(known):
        state.update((zlib.compress(known.T.tobytes(), 1),))
        state.setTimeoutTimestamp(int(ends.max()) * 1000)
    else:
        state.remove()


def run_refusal_stream(
    events: DataFrame, key: str, ts: str, request: str, sink: str, checkpoint: str, per_hour: int = PER_HOUR, per_day: int = PER_DAY, watermark: str = "1 hour",
) -> StreamingQuery:
    """Answer every request when it arrives, read what is there, then stop: ``sink`` gets each with its numbers and ``accepted``.

    Per client the counts of its open hours and days are kept, those of a bucket of clients in one state; a timer drops them once
    the watermark has passed their ends. The requests of a bucket in one micro-batch meet in one task, so batches should be small
    (``maxFilesPerTrigger`` and the like at the source). Requests are numbered in the order of their batches, within a batch by time and id; one that is later
    than the watermark gets no answer. Windows are cut in the session's time zone, which must be UTC.
    """
    stamped = _numbered(events, key, ts, request).withWatermark("at", watermark)
    client, number = F.col("client"), F.col("id")
    # pandas would make integers with gaps doubles
    whole = stamped.select(
        F.pmod(F.xxhash64("client"), F.lit(BUCKETS)).alias("bucket"), client.isNull().alias("no_client"), F.coalesce(client, F.lit(0)).alias("client"),
        number.isNull().alias("no_id"), F.coalesce(number, F.lit(0)).alias("id"), "at",
    )
    answered = whole.groupBy("bucket").applyInPandasWithState(_answer, ANSWERED, "counts binary", "append", GroupStateTimeout.EventTimeTimeout)
    answered = answered.select(
        F.when(~F.col("no_client"), client).alias("client"), F.when(~F.col("no_id"), number).alias("id"), "at", *WIDTHS, _accepted(per_hour, per_day).alias("accepted")
    )
    writer = answered.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").start(sink)
