"""The audit of resource health as a stream: one state per resource, signals released in order by timers.

Signals of a resource arrive in any order. Each is held until the watermark has passed its time; then a timer releases what is held, in the
order of time and place (``ts``, ``seq``, ``pos``), and the running status and error count tell which audit row it makes. A signal that comes after
the watermark passed its time is not lost: it is taken as released now, after what is out already.

The state of a resource is its status and error count, and the signals of one lateness. The signals of one resource in one micro-batch are
worked on by one task, as each row's count depends on the row before; ``maxFilesPerTrigger`` and the like bound them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lograph.operators.health import audit_rows, health_signals, status_rank
from lograph.streaming.sinks import start_batches

SIGNAL = "seq bigint, pos int, ts_us bigint, message string, rank int"
STEPS = f"arn string, {SIGNAL}, place bigint, status0 string, before int, count_before bigint"
CLOSE = ""


class AuditSteps(StatefulProcessor):
    """Signals of one resource in, the steps of its audit out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Known status, worst rank since, errors since, the number of the next step, and the time up to which signals are out.
        self.health = handle.getValueState("health", "status0 string, count0 bigint, worst int, errors bigint, place bigint")
        self.held = handle.getListState("held", SIGNAL)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.health.update((row["status"], int(row["error_count"]), 0, 0, 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == CLOSE:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        late, first = [], None
        for frame in rows:
            signals = [(int(s), int(p), int(t), m, int(r)) for s, p, t, m, r in frame[["seq", "pos", "ts_us", "message", "rank"]].itertuples(index=False)]
            open_ = [s for s in signals if self.moment(s) > watermark]
            late += [s for s in signals if self.moment(s) <= watermark]
            if open_:
                self.held.appendList(open_)
                first = min([self.moment(s) for s in open_] + ([first] if first else []))
        # One timer, at the earliest signal that is held, is enough: it releases all that are due.
        if first and first < min(self.handle.listTimers(), default=first + 1):
            self.handle.registerTimer(first)
        if late:
            yield from self.released(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        signals = list(self.held.get())
        out = [s for s in signals if self.moment(s) <= watermark]
        rest = [s for s in signals if self.moment(s) > watermark]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(min(self.moment(s) for s in rest))
        else:
            self.held.clear()
        yield from self.released(key, out)

    @staticmethod
    def moment(signal: tuple) -> int:
        """The first millisecond that is not before the signal."""
        return -(-signal[2] // 1000)

    def released(self, key, signals: list[tuple]) -> Iterator[pd.DataFrame]:
        status0, count0, worst, errors, place = self.health.get() if self.health.exists() else ("unknown", 0, 0, 0, 0)
        known = {"error": 2, "warning": 1}.get(status0, 0)
        out = []
        for seq, pos, ts, message, rank in sorted(signals, key=lambda s: (s[2], s[0], s[1])):
            before = max(known, worst)
            if before < rank or before == rank == 2:
                out.append((key[0], seq, pos, ts, message, rank, place, status0, before, count0 + errors))
                place += 1
            worst, errors = max(worst, rank), errors + (rank == 2)
        self.health.update((status0, count0, worst, errors, place))
        if out:
            yield pd.DataFrame(out, columns=["arn", "seq", "pos", "ts_us", "message", "rank", "place", "status0", "before", "count_before"])

    def close(self) -> None:
        pass


def health_audit_stream(
    findings: DataFrame, nodes: DataFrame, target: str, checkpoint: str, batch: str, lateness: str = "1 hour", triggered_by: str = "graph_merge",
    closing: DataFrame | None = None, once: bool = True,
) -> StreamingQuery:
    """Audit rows as :func:`lograph.operators.health.health_audit` makes them, with ``place``, the number of the step in its resource.

    ``findings``: seq, ts (TIMESTAMP), severity, message, resource_arns. ``nodes`` (batch): arn, status, error_count of what is known at the start; further
    resources start as unknown. A finding without a time is late. Signals of the last ``lateness`` wait for later ones; ``closing``, a stream of rows with
    ``ts``, releases them: a row later than all signals by more than the lateness, which must come when all findings are in.
    """
    timed = health_signals(findings).withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.timestamp_seconds(F.lit(0))))
    columns = ["arn", "seq", F.col("pos").cast("int").alias("pos"), "ts", "message", "rank"]
    signals = timed.select(*columns)
    if closing is not None:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("seq", "bigint"), ("pos", "int"), ("message", "string"), ("rank", "int"))]
        ends = closing.select(F.lit(CLOSE).alias("arn"), F.col("ts").cast("timestamp").alias("ts"), *none)
        signals = signals.unionByName(ends)
    known = nodes.select("arn", "status", F.col("error_count").cast("bigint").alias("error_count"))
    # The time goes on as a number: rows of a time column that are late would be dropped before they reach the state.
    steps = (
        signals.withWatermark("ts", lateness).withColumn("ts_us", F.unix_micros("ts")).drop("ts").groupBy("arn")
        .transformWithStateInPandas(AuditSteps(), STEPS, "Append", "EventTime", initialState=known.groupBy("arn"))
    )

    def rows(out: DataFrame, _: int) -> DataFrame:
        timed_out = out.withColumn("ts", F.timestamp_micros("ts_us").cast("timestamp_ntz"))
        return audit_rows(timed_out, batch, triggered_by, "place")

    return start_batches(steps, target, checkpoint, "append", rows, once)
