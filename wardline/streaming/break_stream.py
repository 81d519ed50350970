"""Doctor breaks as a keyed stream (§2.11 M5).

Key (doctor, day); the state holds the last start and the last end request.
A start upserts the row and clears its end, an end before any start of the day
does nothing and later ends move it, so the row depends only on which start
and which end come last in (ts, req_id) order: requests may arrive in any
order.  State is loaded from a stored break table (``stored_breaks``) and dropped
once the watermark has passed the end of the day by ``RETENTION_MS``.

Each batch that changes a row emits it as a whole with a growing ``version``;
``latest`` keeps the newest of each key, which is the table of ``break_state``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.requests import ENUMS

RETENTION_MS = 24 * 3600 * 1000
NEVER = -1  # order of a request that has not come

OUTPUT = ("doctor_id int, break_date date, break_start timestamp, break_end timestamp, status string, "
          "is_on_break boolean, version long")


class BreakProcessor(StatefulProcessor):
    """The break row of one (doctor, day)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start_ts long, start_req long, end_ts long, end_req long, version long")

    def close(self) -> None:
        pass

    def _read(self) -> list:
        return list(self.last.get()) if self.last.exists() else [NEVER] * 4 + [0]

    def _keep(self, key, state: list) -> None:
        self.last.update(tuple(state))
        end = pd.Timestamp(key[1]) + pd.Timedelta(days=1)
        self.handle.registerTimer(end.value // 1_000_000 + RETENTION_MS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            ended = not pd.isna(row.break_end)
            self._keep(key, [_us(row.break_start), NEVER, _us(row.break_end) if ended else NEVER, NEVER, 0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._read()
        start, end = tuple(old[0:2]), tuple(old[2:4])
        for pdf in rows:
            for r in pdf[["ts", "req_id", "action"]].itertuples(index=False):
                order = (_us(r.ts), int(r.req_id))
                if r.action == "start_break":
                    start = max(start, order)
                else:
                    end = max(end, order)
        state = [*start, *end, old[4]]
        if state[:4] == old[:4]:
            return
        shown = start[0] != NEVER and self._row(old) != self._row(state)
        state[4] += int(shown)
        self._keep(key, state)
        if shown:
            at, until = self._row(state)
            yield pd.DataFrame([(key[0], key[1], _ts(at), _ts(until), "on_break" if until is None else "available",
                                 until is None, state[4])],
                               columns=[c.split()[0] for c in OUTPUT.split(", ")])

    @staticmethod
    def _row(state: list) -> tuple | None:
        """(start, end) as shown; an end before the last start is none."""
        if state[0] == NEVER:
            return None
        return state[0], state[2] if tuple(state[2:4]) > tuple(state[0:2]) else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])


def _us(ts) -> int:
    return pd.Timestamp(ts).value // 1000


def _ts(us: int | None):
    return pd.NaT if us is None else pd.Timestamp(us * 1000)


def stored_breaks(breaks: DataFrame) -> DataFrame:
    """Rows of ``break_state``, grouped as the state that the stream begins with."""
    return breaks.select("doctor_id", "break_date", F.col("break_start").cast("timestamp").alias("break_start"),
                         F.col("break_end").cast("timestamp").alias("break_end")).groupBy("doctor_id", "break_date")


def break_stream(requests: DataFrame, stored: DataFrame | None = None, lateness: str = "1 day") -> DataFrame:
    """Changed break rows from a stream of requests (req_id, ts, d, doctor_id, action).

    ``stored``: a table like that of ``break_state``; its rows are the state
    before the first request.  The session must use the RocksDB state store.
    """
    r = requests.where(F.col("action").isin(*ENUMS["break_action"]) & (F.col("doctor_id") != 0)).select(
        "doctor_id", F.col("d").alias("break_date"), F.col("ts").cast("timestamp").alias("ts"), "req_id", "action")
    return (r.withWatermark("ts", lateness).groupBy("doctor_id", "break_date")
            .transformWithStateInPandas(BreakProcessor(), OUTPUT, "Update", "EventTime",
                                        None if stored is None else stored_breaks(stored)))


def latest(changes: DataFrame) -> DataFrame:
    """The newest row of each (doctor, day)."""
    row = F.struct("break_start", "break_end", "status", "is_on_break")
    return changes.groupBy("doctor_id", "break_date").agg(F.max_by(row, "version").alias("r")).select(
        "doctor_id", "break_date", "r.*")
