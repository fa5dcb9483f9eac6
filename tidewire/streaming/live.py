"""Live packets with Structured Streaming: windows, sessions, history per session, scores per batch.

Packet streams have ts (TIMESTAMP), capture_id, size, direction, kind and further packet columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener


def read_landing(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8, kind: str = "parquet") -> DataFrame:
    """A stream over the files that land in a folder."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def tumbling_features(packets: DataFrame, length: str = "100 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Counts, bytes and sizes of windows aligned to the epoch (the batch windows start at the first packet); later rows than the watermark go."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", length), "capture_id").agg(F.count(F.lit(1)).alias("pkt_count"), F.sum("size").alias("byte_count"), F.avg("size").alias("mean_len"), F.count_if(F.col("direction") == "up").alias("up_pkt_count"))


def sliding_counts(packets: DataFrame, length: str = "2500 milliseconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    return packets.withWatermark("ts", late).groupBy(F.window("ts", length, step), "capture_id").agg(F.count(F.lit(1)).alias("pkt_count"))


def session_counts(packets: DataFrame, gap: str = "600 milliseconds", late: str = "10 seconds") -> DataFrame:
    return packets.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "capture_id").agg(F.count(F.lit(1)).alias("pkt_count"))


#: Spark's state store that keeps timers and several states for a key.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """The processor over each key, with timers of event time. Streams that start in this session afterwards use the store that it needs."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, mode, "EventTime")


class _Idle(StatefulProcessor):
    """State of one key that ends when no row has come for `idle` seconds of event time: a timer is put off at each update."""

    schema = ""

    def __init__(self, idle: float):
        self.idle = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("own", self.schema)

    def put_off(self, last_ms: int, watermark_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # A timer at or before the watermark would never be asked for.
        self.handle.registerTimer(max(last_ms, watermark_ms) + self.idle + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class _Repeats(_Idle):
    schema = "last long"

    def __init__(self, gap: int, idle: float, names: list[str]):
        super().__init__(idle)
        self.gap, self.names = gap, names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last, kept = self.state.get()[0] if self.state.exists() else None, []
        times = _micros(own["ts"]).tolist()
        for t in times:
            kept.append(last is None or t - last >= self.gap)
            last = t if kept[-1] else last
        self.state.update((last,))
        self.put_off(times[-1] // 1000, timerValues.getCurrentWatermarkInMs())
        yield own[kept][self.names]


def without_repeats(packets: DataFrame, within: float = 0.5, late: str = "10 seconds", idle: float = 600.0) -> DataFrame:
    """Without rows of a (capture_id, kind) that came less than `within` seconds after the last row of it that was kept.

    The rows of a batch are put in order of time; a row older than the last kept one goes. The state is one time for each pair; it
    ends once the watermark (`late` behind the latest row) has passed the pair's last row by `idle` seconds, which must be at least `within`, so
    that nothing changes by its end. Rows behind the watermark go and are counted, see `Totals`.
    """
    if idle < within:
        raise ValueError("idle must not be below within")
    own = packets.withWatermark("ts", late)
    return _stateful(own, ["capture_id", "kind"], _Repeats(int(within * 1_000_000), idle, packets.columns), packets.schema, "Append")


class _History(_Idle):
    schema = "history array<string>"

    def __init__(self, most: int, idle: float, check: Callable[[list[str]], str] | None):
        super().__init__(idle)
        self.most, self.check = most, check

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = list(self.state.get()[0]) if self.state.exists() else []
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for kind in new["kind"]:
            if not own or own[-1] != kind:
                own.append(kind)
        own = own[-self.most :]
        self.state.update((own,))
        self.put_off(int(_micros(new["ts"]).iloc[-1]) // 1000, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"capture_id": [key[0]], "n": [len(own)], "history": [own], "status": [self.check(own) if self.check else None]})


def action_history(packets: DataFrame, most: int = 100, check: Callable[[list[str]], str] | None = None, late: str = "10 seconds", idle: float = 3600.0) -> DataFrame:
    """Per capture and update: how many actions its history holds, the history (kinds that differ from the one before, the last `most`), its status.

    Rows of one update are put in order of time as a whole. check judges the history anew at each update, as `graph_check` does; without
    it the status is null. A capture's history ends once the watermark has passed its last row by `idle` seconds; rows that come later begin a new one.
    """
    own = packets.select("capture_id", "ts", "kind").withWatermark("ts", late)
    return _stateful(own, ["capture_id"], _History(most, idle, check), "capture_id long, n long, history array<string>, status string", "Update")


def graph_check(graph: DataFrame, most: int = 10_000) -> Callable[[list[str]], str]:
    """A check of histories against a learned graph (action, successors, starts): UNKNOWN for actions that it lacks, ANOMALY for steps that
    it doesn't hold, else NORMAL. The history may have lost its beginning, so its first action may be any. The graph goes to the
    tasks whole, as it has one row for each kind of action, `most` at most."""
    rows = graph.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("the graph has too many actions")
    follows = {r.action: set(r.successors) for r in rows}

    def check(history: list[str]) -> str:
        if any(a not in follows for a in history):
            return "UNKNOWN"
        return "NORMAL" if all(b in follows[a] or a == b for a, b in zip(history[:-1], history[1:], strict=True)) else "ANOMALY"

    return check


def score_batches(packets: DataFrame, score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A writer that scores each micro-batch with a batch operator and hands the result to a sink, which must take a repeated batch id."""

    def run(df: DataFrame, i: int) -> None:
        own = df.persist()  # scoring reads a batch several times
        try:
            sink(score(own), i)
        finally:
            own.unpersist()

    return packets.writeStream.foreachBatch(run)


def read_captures(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of frames from capture files that land in a folder; each file is read once, when it is whole."""
    from ..sources.capture import decode_captures

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pcap").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return decode_captures(files)


class Totals(StreamingQueryListener):
    """What the streams of a session have done since they began, by query id: batches, rows, late rows that were dropped, rows of state, the last observations, the error.

    A query's own progress forgets all but its last hundred batches. Late rows are counted where an operator drops them: for windows
    that is after the rows of one task that fall into one group and window have been counted together.
    """

    def __init__(self) -> None:
        self.queries: dict[str, dict] = {}

    def of(self, query) -> dict:
        return self._own(query.id)

    def _own(self, key) -> dict:
        return self.queries.setdefault(str(key), {"batches": 0, "rows": 0, "late": 0, "state": 0, "latest": {}, "error": None, "ended": False})

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._own(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p, own = event.progress, self._own(event.progress.id)
        own["batches"] = max(own["batches"], p.batchId + 1)
        own["rows"] += p.numInputRows
        own["late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        own["state"] = sum(s.numRowsTotal for s in p.stateOperators)
        for name, row in (p.observedMetrics or {}).items():
            own["latest"][name] = row

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._own(event.id).update(error=event.exception, ended=True)


def run_available(frame: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over what is there now, in as many batches as its source makes, and return what it has put out.

    The output and the stream's own state are below the folder, which the driver and the executors must share. Rows of update mode are
    all kept, the batch that they came in is the column batch.
    """

    def put(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return frame.sparkSession.read.parquet(f"{folder}/out")


def progress(query, name: str = "live") -> dict:
    """What a stream has done of late: batches, rows, its last error, and the last observation made under a name."""
    ran = query.recentProgress
    seen = [p["observedMetrics"][name] for p in ran if name in (p["observedMetrics"] or {})]
    error = query.exception()
    return {"batches": len(ran), "rows": sum(p["numInputRows"] for p in ran), "latest": seen[-1] if seen else None, "error": str(error) if error else None}


def counted(packets: DataFrame, name: str = "live") -> DataFrame:
    """The stream with packets, bytes and last time of each batch observed under a name."""
    return packets.observe(name, F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), F.max("ts").alias("last"))
