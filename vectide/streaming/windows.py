"""Streams: arrivals, sliding windows of index slices, and batches of requests that wait their turn."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ranged(rows: DataFrame, order: str, ranges: int) -> DataFrame:
    """Adds __range: which of about `ranges` equally wide ranges of a whole-number column a row is in; nulls come first."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    return rows.withColumn("__range", F.coalesce(F.floor((F.col(order) - F.lit(low or 0)) / width), F.lit(-1)))


def arrivals(requests: DataFrame, rate: float, seed: int = 2025, ranges: int = 64) -> DataFrame:
    """Adds start_time: exponential gaps summed in order of id (whole numbers). Gaps come from a hash of id and seed, so
    reruns agree. Ranges of ids are summed by themselves and then moved by the sum of all before, so no task has all rows."""
    share = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    gaps = _ranged(requests.withColumn("gap", -F.ln(1 - share) / F.lit(rate)), "id", ranges)
    sums = gaps.groupBy("__range").agg(F.sum("gap").alias("s"))
    before = sums.select("__range", F.coalesce(F.sum("s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))  # one row a range
    inside = F.sum("gap").over(Window.partitionBy("__range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return gaps.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("start_time", F.col("__before") + F.col("__inside")).drop("gap", "__range", "__inside", "__before")


def lagged(rows: DataFrame, by: str, order: str, value: str, name: str, ranges: int = 64) -> DataFrame:
    """Adds `name`: what `value` was in the row before, in order of the whole-number column `order`, of the same `by`; null
    for the first. A key's rows are cut in ranges, and the first of each range takes the last of the nearest range before."""
    cut = _ranged(rows, order, ranges)
    inside = Window.partitionBy(by, "__range").orderBy(order)
    marked = cut.withColumn(name, F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    last = cut.groupBy(by, "__range").agg(F.max_by(value, F.struct(order)).alias("__last"))
    edge = last.withColumn("__last", F.lag("__last").over(Window.partitionBy(by).orderBy("__range")))  # a row a range
    edge = edge.withColumnsRenamed({by: "__by", "__range": "__of"})
    joined = marked.join(edge, marked[by].eqNullSafe(edge["__by"]) & (marked["__range"] == edge["__of"]), "left")
    return joined.withColumn(name, F.when(F.col("__first"), F.col("__last")).otherwise(F.col(name))).select(*rows.columns, name)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value) of a stream or a table of events; late rows beyond the watermark are dropped
    by a stream."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n)."""
    counted = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), "n")


def search_stream(requests: DataFrame, answer, sink_path: str, checkpoint: str):
    """Answer a stream of requests in micro-batches: `answer(DataFrame) -> DataFrame` runs on each, results are appended as
    Parquet. Returns the started query."""

    def each(batch: DataFrame, _: int) -> None:
        answer(batch).write.mode("append").parquet(sink_path)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_best(hits: DataFrame, k: int, last_stage: int) -> DataFrame:
    """(q_id, stage, vec_ids, scores): a stream of partial results (q_id, stage, vec_id, score) of searches that go on in
    mini-batches. The state of a request is its k best so far; a row comes out each time it moves, and with the last stage
    the state goes."""

    def step(key, frames, state: GroupState):
        ids, scores, stage = (list(x) for x in state.get) if state.exists else ([], [], [-1])
        for frame in frames:
            ids += frame["vec_id"].tolist()
            scores += frame["score"].tolist()
            stage = [max(stage[0], int(frame["stage"].max()))]
        best = sorted(zip(scores, ids))[:k]
        ids, scores = [i for _, i in best], [s for s, _ in best]
        if stage[0] >= last_stage:
            state.remove()
        else:
            state.update((ids, scores, stage))
        yield pd.DataFrame({"q_id": [key[0]], "stage": stage, "vec_ids": [ids], "scores": [scores]})

    kept = "vec_ids array<long>, scores array<double>, stage array<long>"
    return hits.groupBy("q_id").applyInPandasWithState(step, "q_id long, stage long, vec_ids array<long>, scores array<double>", kept, "update", GroupStateTimeout.NoTimeout)
