"""Structured Streaming forms of the status fold (§2.11 M1, M3, M4).

Requests arrive on a stream (file source here; any streaming source works).
Each request is joined with the token table (stream-static join) and routed
to the state key it affects:

* its own status change goes to key (department, token day);
* a ``consulting`` request also goes, as a reset, to key (department,
  request day), because a consulting request first completes every other
  consulting token of that department created on the request day.

``transformWithState`` keeps per key a map of tokens, a map of those that are
consulting, and a list of events that wait for their turn.  An event waits
until the frontier -- the latest event time seen less ``lateness`` -- has
passed it; a timer wakes the key then, and waiting events are applied in
(ts, req_id) order, within one request the own change before its reset.  So
events may come in any order inside ``lateness`` and the result is that of the
batch twins.  Only touched tokens are read from the state store.  Outputs:

* ``alert`` rows on transitions into cancelled / consulting (polling stops
  after a cancellation, so at most one cancel alert per token);
* ``status`` rows: every status change, including tokens completed by
  another token's consulting request (the M3 feed);
* ``expired`` rows when the frontier passes the end of the key's day by
  ``RETENTION``: tokens still waiting or consulting at midnight, after which
  the key's state is dropped (bounded state);
* ``late`` rows for events behind the frontier when they arrive, and for those
  of days that are closed (dead letter; they are not applied).  Events more
  than ``GRACE`` behind are counted by Spark as dropped.

Token arrivals are part of the stream (the issue endpoints emit them), at
the start of their day, so a key knows every token of its day.

Hot keys: a (department, day) may hold a large share of all tokens.  It has as
many keys as its tokens need at ``TOKENS_PER_KEY`` each (``key_counts``, from
the token table); a token's own events and its arrival go to its key and a
reset is copied to all keys of its (department, day), so the result is the
same.

The session must use the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.lookups import LATE_REASON
from wardline.operators.requests import ENUMS
from wardline.streaming.alerts import (CANCEL_BODY, CANCEL_TITLE, DEFAULT_PLACE, TURN_BODY,
                                       TURN_TITLE)

REQUEST_SCHEMA = T.StructType([
    T.StructField("req_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("d", T.DateType()),
    T.StructField("token_id", T.LongType()),
    T.StructField("new_status", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("department_id", T.IntegerType()),
    T.StructField("key_day", T.DateType()),
    T.StructField("bucket", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),  # event time (watermarks need TIMESTAMP)
    T.StructField("req_id", T.LongType()),
    T.StructField("kind", T.IntegerType()),      # 0 arrival, 1 own change, 2 reset
    T.StructField("token_id", T.LongType()),
    T.StructField("new_status", T.StringType()),
    T.StructField("token_number", T.StringType()),
    T.StructField("doctor_name", T.StringType()),
])

OUTPUT_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),       # alert | status | expired | late
    T.StructField("token_id", T.LongType()),
    T.StructField("req_id", T.LongType()),
    T.StructField("queue_date", T.DateType()),
    T.StructField("alert", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("ts", T.TimestampType()),      # event time of the causing request
])

DAY_MS = 24 * 3600 * 1000
LATENESS = "1 day"
RETENTION_MS = DAY_MS        # after the end of its day a key still applies requests
GRACE_MS = 7 * DAY_MS        # how far behind the frontier an event is still reported as late
TOKENS_PER_KEY = 50_000


def key_counts(tokens: DataFrame, tokens_per_key: int = TOKENS_PER_KEY) -> DataFrame:
    """(department_id, key_day, keys): how many state keys each department and day has."""
    return tokens.groupBy("department_id", F.col("queue_date").alias("key_day")).agg(
        F.ceil(F.count(F.lit(1)) / tokens_per_key).cast("int").alias("keys"))


def _bucket() -> F.Column:
    return F.pmod(F.xxhash64("token_id"), F.coalesce("keys", F.lit(1))).cast("int").alias("bucket")


def route_requests(requests: DataFrame, tokens: DataFrame, doctors: DataFrame,
                   tokens_per_key: int = TOKENS_PER_KEY) -> DataFrame:
    """Stream-static join and routing of requests to state keys; arrivals are
    built from the token table by the caller (``arrival_events``)."""
    counts = key_counts(tokens, tokens_per_key)
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"))
    t = tokens.select(F.col("id").alias("token_id"), "department_id", F.col("queue_date").alias("tday"),
                      "token_number", "doctor_id").join(doc, "doctor_id", "left").drop("doctor_id")
    r = requests.where(F.col("new_status").isin(*ENUMS["opd_status"])).join(t, "token_id")
    last = [F.col("ts").cast("timestamp").alias("ts"), "req_id"]
    rest = ["token_id", "new_status", "token_number", "doctor_name"]
    own = r.withColumn("key_day", F.col("tday")).join(counts, ["department_id", "key_day"], "left").select(
        "department_id", "key_day", _bucket(), *last, F.lit(1).alias("kind"), *rest)
    reset = r.where(F.col("new_status") == "consulting").withColumn("key_day", F.col("d")).join(
        counts, ["department_id", "key_day"]).select(
        "department_id", "key_day", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)).alias("bucket"), *last,
        F.lit(2).alias("kind"), *rest)
    return own.unionByName(reset)


def arrival_events(tokens: DataFrame, doctors: DataFrame, tokens_per_key: int = TOKENS_PER_KEY) -> DataFrame:
    """Token arrivals, stamped at the start of their day (the snapshot is the
    state before the requests)."""
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"))
    t = tokens.join(doc, "doctor_id", "left").withColumnsRenamed({"queue_date": "key_day", "id": "token_id"})
    t = t.join(key_counts(tokens, tokens_per_key), ["department_id", "key_day"])
    return t.select("department_id", "key_day", _bucket(), F.col("key_day").cast("timestamp").alias("ts"),
                    F.lit(-1).cast("long").alias("req_id"), F.lit(0).alias("kind"), "token_id",
                    F.col("status").alias("new_status"), "token_number", "doctor_name")


def _us(ts) -> int:
    return pd.Timestamp(ts).value // 1000


class StatusProcessor(StatefulProcessor):
    """The status fold of one (department, day, bucket)."""

    def __init__(self, grace_ms: int = GRACE_MS, retention_ms: int = RETENTION_MS):
        self.grace_ms, self.retention_ms = grace_ms, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # close: the status at the end of the day, once an event behind it has come ('' before)
        self.tokens = handle.getMapState("tokens", "token_id long", "status string, close string, quiet boolean")
        self.consulting = handle.getMapState("consulting", "token_id long", "req_id long")
        self.waiting = handle.getListState(
            "waiting", "ts long, req_id long, kind int, token_id long, new_status string, token_number string, "
                       "doctor_name string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frontier = self._frontier(timerValues)
        out, new = [], []
        closed = frontier >= self._closes(key)
        for pdf in rows:
            for e in pdf[["ts", "req_id", "kind", "token_id", "new_status", "token_number",
                          "doctor_name"]].itertuples(index=False):
                at = _us(e.ts)
                if at < frontier or closed:
                    if e.kind != 0:
                        out.append(self._row(key, "late", e.token_id, e.req_id, at))
                        continue
                    if closed:
                        continue
                new.append((at, int(e.req_id), int(e.kind), int(e.token_id), e.new_status, e.token_number,
                            e.doctor_name if isinstance(e.doctor_name, str) else ""))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(self._timer(self._closes(key)))
        yield from self._advance(key, frontier, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, self._frontier(timerValues), [])

    def _frontier(self, timer_values) -> int:
        """Event time in microseconds up to which everything has come."""
        return (timer_values.getCurrentWatermarkInMs() + self.grace_ms) * 1000

    def _timer(self, at_us: int) -> int:
        """The watermark at which the frontier has passed an event time."""
        return at_us // 1000 + 1 - self.grace_ms

    def _day_end(self, key) -> int:
        return _us(pd.Timestamp(key[1]) + pd.Timedelta(days=1))

    def _closes(self, key) -> int:
        return self._day_end(key) + self.retention_ms * 1000

    def _advance(self, key, frontier: int, out: list) -> Iterator[pd.DataFrame]:
        """Apply what the frontier has passed, close the day, and set the next timer."""
        if self.waiting.exists():
            events = sorted(self.waiting.get())
            due = [e for e in events if e[0] < frontier]
            rest = events[len(due):]
            if due:
                self._apply(key, due, out)
                if rest:
                    self.waiting.put(rest)
                else:
                    self.waiting.clear()
            if rest:
                self.handle.registerTimer(self._timer(rest[0][0]))
        if frontier >= self._closes(key):
            for (token,), (status, close, _) in self.tokens.iterator():
                if (close or status) in ("waiting", "consulting"):
                    out.append(self._row(key, "expired", token, None, self._day_end(key)))
            for state in (self.tokens, self.consulting, self.waiting):
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in OUTPUT_SCHEMA.fields])

    def _row(self, key, kind, token, req, at, alert=None, title=None, message=None) -> tuple:
        return (kind, int(token), None if req is None else int(req), key[1], alert, title, message,
                pd.Timestamp(at * 1000))

    def _apply(self, key, events: list, out: list) -> None:
        day_end = self._day_end(key)
        for at, req, kind, token, new, number, doctor in events:
            if kind == 2:  # completes every other consulting token of the key
                for (other,) in list(self.consulting.keys()):
                    if other != token:
                        _, close, quiet = self.tokens.getValue((other,))
                        self.tokens.updateValue((other,), ("completed", close, quiet))
                        self.consulting.removeKey((other,))
                        out.append(self._row(key, "status", other, req, at, "completed"))
                continue
            known = self.tokens.getValue((token,)) if self.tokens.containsKey((token,)) else None
            if kind == 0:
                if known is None:
                    self.tokens.updateValue((token,), (new, "", False))
                    if new == "consulting":
                        self.consulting.updateValue((token,), (req,))
                continue
            before, close, quiet = known or (None, "", False)
            if new != before:
                if new in ("cancelled", "consulting") and not quiet:
                    cancel = new == "cancelled"
                    text = (CANCEL_BODY.format(token=number, reason=LATE_REASON) if cancel
                            else TURN_BODY.format(token=number, place=doctor or DEFAULT_PLACE))
                    out.append(self._row(key, "alert", token, req, at, new, CANCEL_TITLE if cancel else TURN_TITLE, text))
                    quiet = quiet or cancel
                out.append(self._row(key, "status", token, req, at, new))
            if at >= day_end and not close:
                close = before or ""
            self.tokens.updateValue((token,), (new, close, quiet))
            if new == "consulting":
                self.consulting.updateValue((token,), (req,))
            elif before == "consulting":
                self.consulting.removeKey((token,))


def status_fold_stream(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Keyed stateful fold over routed events (arrivals + requests)."""
    delay = f"{int(pd.Timedelta(lateness).total_seconds()) + GRACE_MS // 1000} seconds"
    return (events.withWatermark("ts", delay)
            .groupBy("department_id", "key_day", "bucket")
            .transformWithStateInPandas(StatusProcessor(), OUTPUT_SCHEMA, "Append", "EventTime"))
