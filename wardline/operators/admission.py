"""One active token per patient: the admission check of the issue endpoints, replayed over whole logs.

A request is refused while the patient has an active token of the day.  A
patient who is logged in is known by the account, others by phone; a token
carries both, so one that an account opened is also found by its phone.  Tokens
stored before the log count from the start of their day, and a booking can be
checked in once.  Which requests open tokens depends on the requests before
them.

All requests of a key (account or phone) and day have places 0, 1, 2, ...  A
token covers stretches of these places: from behind its own request to the
change that ends it, and again if a later change revives it.  Given what else
covers the day, a key's accepted requests form a chain: the first free request,
then the first free one behind the end of the token that it opens, and so on.
"The next one" is a pointer from place to place, and doubling the pointers
finds every request on the chain in a logarithmic number of joins, so a busy
patient is spread over tasks like anybody else.

A request that a stored token covers can open none, so the tokens of all other
requests are the only ones to be replayed.  What else covers the day -- tokens
that accounts opened, revived tokens, bookings that are taken -- is known from the accepted requests
of the round before.  Rounds repeat until nothing changes.  Effects only go
forward in time, so each round settles at least the next request in which
something was still open, and the result is that of the replay in order.  A
round replays only the keys and days for which something else has changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.columns import LAB_ACTIVE, OPD_ACTIVE
from wardline.operators.ranking import hot_group_rows, lag_within, number_rows, running_sum

# Fixed texts of the application.
_ACCOUNT = "{kind} token ({token}) from your account. Only one token per account is allowed. "
_PHONE = "{kind} token ({token}). You can only have one token at a time. "
_END = "Please complete, cancel, or wait for it to expire"
REFUSALS = {
    ("opd", True): "You already have an active " + _ACCOUNT + _END + ".",
    ("opd", False): "You already have an active " + _PHONE + _END + ".",
    ("checkin", True): "You already have an active " + _ACCOUNT + _END + " before checking in.",
    ("checkin", False): "You already have an active " + _PHONE + _END + " before checking in.",
    ("lab", True): "You already have an active token ({token}) from your account in {place}. "
                   "Only one token per account is allowed. " + _END + ".",
    ("lab", False): "You already have an active token ({token}) in {place}. Status: {status}. " + _END + ".",
}
KIND_LABEL = {"opd": "OPD consultation", "lab": "Lab test"}
PLACE_LABEL = {"opd": "OPD", "lab": "Lab"}
FIRST_STATUS = "waiting"

_NEVER = 1 << 60                 # a place behind all requests
_START = "1900-01-01 00:00:00"   # stored tokens are there before any request
_GROUP = ["key", "d"]


def account_key(patient_id: Column) -> Column:
    return F.concat(F.lit("a:"), patient_id.cast("string"))


def phone_key(phone: Column) -> Column:
    return F.when(F.coalesce(F.trim(phone), F.lit("")) != "", F.concat(F.lit("p:"), phone))


def _is_active(lab: Column, status: Column) -> Column:
    return F.when(lab, status.isin(*LAB_ACTIVE)).otherwise(status.isin(*OPD_ACTIVE))


def _not_repeated(changes: DataFrame) -> DataFrame:
    """Changes with ``after``: the time of the change before, if the token's state was the same then (null: it was
    not): the same status, or inactive both times."""
    state = F.struct("status", _is_active(F.col("lab"), F.col("status")).alias("active"), "ts")
    x = lag_within(changes.withColumn("state", state), ["lab", "token_id"], ["ts", "id"], "state", "prev")
    same = (F.col("prev.status") == F.col("status")) | (~F.col("prev.active") & ~F.col("state.active"))
    return x.withColumn("after", F.when(same, F.col("prev.ts"))).drop("state", "prev")


def _seen(requests: DataFrame) -> DataFrame:
    """(key, d, until): the last request of each key and day."""
    return requests.groupBy(*_GROUP).agg(F.max("ts").alias("until"))


def _keys() -> Column:
    return F.array_compact(F.array(account_key(F.col("patient_id")), phone_key(F.col("phone"))))


def _told(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of stored tokens, without those that repeat the token's state."""
    token = ["lab", "token_id"]
    # ids of other tokens are often all smaller or larger: their changes are not shuffled
    ids = [(F.col("lab") == r.lab) & F.col("token_id").between(r.low, r.high) for r in stored.groupBy("lab").agg(
        F.min("token_id").alias("low"), F.max("token_id").alias("high")).collect() if r.low is not None]
    within = reduce(lambda x, y: x | y, ids, F.lit(False))
    start = F.to_timestamp_ntz(F.lit(_START))
    about = changes.where(within & (F.col("ts") >= start)).join(stored.select(*token), token, "left_semi")
    return _not_repeated(about).where("after is null").drop("after")


def _stored_spans(requests: DataFrame, stored: DataFrame, changes: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Stretches of stored tokens, as ``_spans`` gives them, and (key, d, best_opd, best_lab): the first token of each
    sort that covers a key and day as a whole.

    A token that is active all day refuses every request of its key and day, so it hides the tokens behind it in the
    order of blockers: these are left out, and neither is placed.
    """
    start = F.to_timestamp_ntz(F.lit(_START))
    told = keep(_told(stored, changes), "told")
    first = told.groupBy("lab", "token_id").agg(F.min("ts").alias("first"))
    opened = stored.join(first, ["lab", "token_id"], "left").select(
        "lab", "token_id", "d", "status", "first", F.explode(_keys()).alias("key")).join(_seen(requests), _GROUP)
    active = F.coalesce(_is_active(F.col("lab"), F.col("status")), F.lit(False))
    # a change behind the last request is none
    changed = F.col("first").isNotNull() & F.coalesce(F.col("first") < F.col("until"), F.lit(True))
    opened = opened.where(F.coalesce(start <= F.col("until"), F.lit(True))).withColumn("active", active).withColumn(
        "changed", changed).where("active or changed").drop("first")
    opened = keep(opened, "stored-opened")
    first_of = [F.min(F.when(x, F.col("token_id"))).alias(n) for x, n in ((~F.col("lab"), "best_opd"), (F.col("lab"), "best_lab"))]
    whole = opened.where("not changed").groupBy(*_GROUP).agg(*first_of)
    whole = keep(whole.where("best_opd is not null or best_lab is not null"), "whole")
    left = keep(_not_hidden(opened, whole), "left")
    none = (F.lit(None).cast("long").alias("uid"), F.lit(False).alias("home"))
    part = left.where("changed")
    events = part.where("active").select(*_GROUP, "lab", "token_id", *none, "status", start.alias("ts"),
                                         F.lit(-1).alias("step"), F.lit(0).cast("long").alias("id"))
    later = part.select(*_GROUP, "lab", "token_id", "until").join(told, ["lab", "token_id"]).where(
        F.coalesce(F.col("ts") < F.col("until"), F.lit(True))).select(
        *_GROUP, "lab", "token_id", *none, "status", "ts", F.lit(1).alias("step"), "id")
    spans, _ = _stretches(requests.join(part, _GROUP, "left_semi"), events.unionByName(later), keep, "stored-")
    always = left.where("not changed").select(
        *_GROUP, "lab", "token_id", *none, F.lit(True).alias("first"), "status", F.lit(0).cast("long").alias("low"),
        F.lit(_NEVER).alias("high"), F.lit(_NEVER).alias("off"))
    return keep(spans.unionByName(always.select(*spans.columns)), "stored-spans"), whole


def _not_hidden(tokens: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of ``tokens`` that no token of ``whole`` is in front of as a blocker: OPD before lab, then by id."""
    opd, lab, number = F.col("best_opd"), F.col("best_lab"), F.col("token_id")
    hidden = F.when(~F.col("lab"), number > opd).otherwise(opd.isNotNull() | (number > lab))
    return tokens.join(whole, _GROUP, "left").where(~F.coalesce(hidden, F.lit(False))).drop("best_opd", "best_lab")


def _spans(requests: DataFrame, asks: DataFrame, whole: DataFrame, changes: DataFrame, issued_base: int,
           keep) -> tuple[DataFrame, str]:
    """(key, d, lab, token_id, uid, home, first, status, low, high, off): the stretches of places that the token of each
    ask would cover in the keys that find it, with one row of the first active stretch at least in its own key.

    uid is the request that would open the token; home tells its own key; off is the place at which
    its first active time ends.  What happens behind the last request of a key and day is left out, as are tokens that a
    token of ``whole`` hides.  Also returns how the rounds rank: with windows, unless a key and day could exceed the limit of a hot group.
    """
    opened = asks.select(
        (F.col("kind") == "lab").alias("lab"), (F.lit(issued_base) + F.col("uid")).alias("token_id"), "d",
        F.lit(FIRST_STATUS).alias("status"), "uid", F.col("key").alias("own"), "ts", F.lit(0).alias("step"),
        F.col("uid").alias("id"), F.explode(_keys()).alias("key"))
    opened = opened.withColumn("home", F.coalesce(F.col("own") == F.col("key"), F.lit(False))).drop("own")
    opened = opened.join(_seen(requests), _GROUP).where(F.coalesce(F.col("ts") <= F.col("until"), F.lit(True)))
    opened = keep(_not_hidden(opened, whole), "opened")
    about = opened.select(*_GROUP, "lab", "token_id", "uid", "home", F.col("ts").alias("since"), "until")
    own = _not_repeated(changes.join(opened.select("lab", "token_id"), ["lab", "token_id"], "left_semi"))
    repeated = F.coalesce(F.col("after") >= F.col("since"), F.lit(False))
    later = about.join(own, ["lab", "token_id"]).where(
        (F.col("ts") >= F.col("since")) & F.coalesce(F.col("ts") < F.col("until"), F.lit(True)) & ~repeated).select(
        *_GROUP, "lab", "token_id", "uid", "home", "status", "ts", F.lit(1).alias("step"), "id")
    events = opened.drop("until")
    spans, strategy = _stretches(requests.join(opened, _GROUP, "left_semi"),
                                 events.unionByName(later.select(*events.columns)), keep, "")
    return keep(spans, "spans"), strategy


def _stretches(requests: DataFrame, events: DataFrame, keep, label: str) -> tuple[DataFrame, str]:
    """The stretches between the events of each token, and how their places were counted."""
    # requests in front of each event
    marks = requests.select(*_GROUP, F.lit(None).cast("boolean").alias("lab"), F.lit(None).cast("long").alias("token_id"),
                            F.lit(None).cast("long").alias("uid"), F.lit(None).cast("boolean").alias("home"),
                            F.lit(None).cast("string").alias("status"), "ts", F.lit(0).alias("step"),
                            F.col("uid").alias("id"), F.lit(1).alias("ask"))
    # written before the scans: the check for hot groups and the scans read the rows
    line = keep(marks.unionByName(events.withColumn("ask", F.lit(0))), f"{label}line")
    strategy = _strategy(line)
    line = running_sum(line, _GROUP, ["ts", "step", "id", F.desc("ask"), "lab", "token_id"], "ask", "place",
                       strategy=strategy)
    events = line.where("ask = 0").drop("ask").withColumn("active", _is_active(F.col("lab"), F.col("status")))
    token = [*_GROUP, "lab", "token_id"]
    order = F.struct("ts", "step", "id", "place")
    end = F.min(F.when(~F.col("active"), order))
    last = [F.desc("ts"), F.desc("step"), F.desc("id")]
    if strategy == "window":   # a key and day is in one task already: no more shuffles
        events = lag_within(events, token, last, "place", "high", strategy=strategy)
        events = events.withColumn("off", end.over(Window.partitionBy(*token)))
    else:
        events = keep(events, f"{label}placed")
        off = events.groupBy(*token).agg(end.alias("off"))
        events = lag_within(events, token, last, "place", "high").join(off, token, "left")
    spans = events.where("active").select(
        *token, "uid", "home", (F.col("off").isNull() | (order < F.col("off"))).alias("first"), "status",
        F.col("place").alias("low"), F.coalesce("high", F.lit(_NEVER)).alias("high"),
        F.coalesce("off.place", F.lit(_NEVER)).alias("off"))
    return spans.where("low < high or home and first"), strategy


def _strategy(line: DataFrame) -> str:
    rows = line.groupBy(*_GROUP).count()
    return "window" if rows.where(F.col("count") * 2 > hot_group_rows(line.sparkSession)).isEmpty() else "auto"


def _free(requests: DataFrame, busy: DataFrame, strategy: str) -> DataFrame:
    """Requests at places that no busy stretch covers."""
    edge = busy.where("low < high")
    steps = edge.select(*_GROUP, F.col("low").alias("place"), F.lit(1).alias("v")).unionByName(
        edge.where(F.col("high") < _NEVER).select(*_GROUP, F.col("high").alias("place"), F.lit(-1).alias("v")))
    line = steps.groupBy(*_GROUP, "place").agg(F.sum("v").alias("v")).select(
        *_GROUP, "place", "v", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("end"))
    line = line.unionByName(requests.select(*_GROUP, "place", F.lit(0).cast("long").alias("v"), "uid", "end"))
    line = running_sum(line, _GROUP, ["place", F.col("uid").asc_nulls_first()], "v", "over", strategy=strategy)
    return line.where("uid is not null and over = 0").select(*_GROUP, "place", "uid", "end")


def _chain(free: DataFrame, keep, strategy: str) -> DataFrame:
    """(uid, key, d): the first free request of each key and day, and from each one the first behind its token's end."""
    marks = F.array(F.struct("place", F.lit(1).alias("ask")), F.struct(F.col("end").alias("place"), F.lit(0).alias("ask")))
    marks = free.select(*_GROUP, "uid", F.explode(marks).alias("m")).select(*_GROUP, "uid", "m.place", "m.ask")
    # free requests in front: a request's own number, and that of the first one at or behind an end
    line = running_sum(marks.where(F.col("place") < _NEVER), _GROUP, ["place", "ask", "uid"], "ask", "n",
                       strategy=strategy)
    line = keep(line, "line")
    nodes = line.where("ask = 1").select(*_GROUP, (F.col("n") - 1).alias("q"), "uid")
    to = line.where("ask = 0").select("uid", F.col("n").alias("next"))
    jump = nodes.join(to, "uid").select(*_GROUP, "q", "next")
    reached = nodes.where("q = 0").select(*_GROUP, "q")
    step = 0
    while True:
        jump = keep(jump, f"jump-{step}")
        more = keep(reached.join(jump, [*_GROUP, "q"]).select(*_GROUP, F.col("next").alias("q"))
                    .join(nodes.select(*_GROUP, "q"), [*_GROUP, "q"], "left_semi"), f"more-{step}")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        ahead = jump.select(*_GROUP, F.col("q").alias("next"), F.col("next").alias("far"))
        jump = jump.join(ahead, [*_GROUP, "next"]).select(*_GROUP, "q", F.col("far").alias("next"))
        step += 1
    return nodes.join(reached, [*_GROUP, "q"], "left_semi").select("uid", *_GROUP)


def _flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(uid): those in only one of two sets."""
    return before.join(after, "uid", "left_anti").select("uid").unionByName(
        after.join(before, "uid", "left_anti").select("uid"))


def _taken(accepted: DataFrame, asks: DataFrame) -> DataFrame:
    """(uid): check-ins of a booking behind the one that checked it in."""
    order = F.struct("ts", "uid")
    visits = asks.where("booking is not null").select("uid", "ts", "booking")
    first = visits.join(accepted, "uid").groupBy("booking").agg(F.min(order).alias("first"))
    return visits.join(first, "booking").where(order > F.col("first")).select("uid")


def _blockers(requests: DataFrame, spans: DataFrame, largest: int) -> DataFrame:
    """(uid, blocker): for each covered request the first covering token, OPD before lab, then by id.

    A stretch is cut into blocks of 4^k places, at most six of each size; a place looks up the one block of each
    size that holds it.  So requests and tokens of a busy key meet in equi joins without all pairs.  A stretch over
    all places meets every request of its key and day and is not cut.
    """
    top = int(largest) + 1
    always = (F.col("low") == 0) & (F.col("high") == _NEVER)
    cut = spans.where(~always).select(*_GROUP, "lab", "token_id", "status", "low", F.least("high", F.lit(top)).alias("high"))
    # sizes up to the stretch's own length
    k = F.expr("cast((length(bin(high - low)) - 1) div 2 as int)")   # no block is longer than the stretch
    cut = cut.where("low < high").withColumn("k", F.explode(F.sequence(F.lit(0), k)))
    cut = cut.withColumn("l", F.expr("shiftright(low + shiftleft(1L, 2 * k) - 1, 2 * k)")).withColumn(
        "r", F.expr("shiftright(high, 2 * k)")).where("l < r")
    # those that no larger block holds: in front of b and from e on
    cut = cut.withColumn("b", F.expr("shiftright(l + 3, 2) * 4")).withColumn("e", F.expr("shiftright(r, 2) * 4"))

    def run(low: str, high: str) -> Column:
        some = F.when(F.col(low) < F.col(high), F.sequence(F.col(low), F.col(high) - 1))
        return F.coalesce(some, F.array().cast("array<bigint>"))

    at = F.when(F.col("b") < F.col("e"), F.concat(run("l", "b"), run("e", "r"))).otherwise(run("l", "r"))
    reach = cut.groupBy(*_GROUP).agg(F.max("k").cast("int").alias("reach"))   # the largest size of a key and day
    blocks = cut.select(*_GROUP, "k", F.explode(at).alias("block"), F.struct("lab", "token_id", "status").alias("b"))
    blocks = blocks.groupBy(*_GROUP, "k", "block").agg(F.min("b").alias("b"))
    k = F.explode(F.sequence(F.lit(0), F.col("reach"))).alias("k")
    asked = requests.join(reach, _GROUP).select("uid", *_GROUP, "place", k).withColumn("block", F.expr("shiftright(place, 2 * k)"))
    whole = spans.where(always).groupBy(*_GROUP).agg(F.min(F.struct("lab", "token_id", "status")).alias("b"))
    found = asked.join(blocks, [*_GROUP, "k", "block"]).select("uid", "b").unionByName(
        requests.join(whole, _GROUP).select("uid", "b"))
    return found.groupBy("uid").agg(F.min("b").alias("blocker"))


def admit(asks: DataFrame, stored: DataFrame, changes: DataFrame, issued_base: int, keep) -> DataFrame:
    """(uid, admitted, taken, by_account, blocker_kind, blocker_token_id, blocker_status), one row for each ask.

    ``asks``: uid (unique), kind (opd, lab, checkin), ts, d, patient_id, phone, valid (opens a token if admitted),
    booking (of a check-in).  ``stored``: lab, token_id, d, patient_id, phone, status.  ``changes``: lab, token_id,
    ts, id, status, for tokens of both sorts; the token of an ask has the id ``issued_base`` + uid.  A request comes
    before a change of the same time.  ``keep(df, name)`` writes a table and returns its scan.

    Asks without account and phone are not checked.  ``taken``: the booking was checked in before.
    """
    account = F.col("patient_id").isNotNull()
    asks = keep(asks.withColumn("key", F.when(account, account_key(F.col("patient_id"))).otherwise(
        phone_key(F.col("phone")))), "asks")
    requests = number_rows(asks.where("key is not null"), _GROUP, ["ts", "uid"], "place")
    requests = keep(requests.withColumn("place", F.col("place") - 1).select(*_GROUP, "place", "uid", "ts", "valid"),
                    "requests")
    stored_spans, whole = _stored_spans(requests, stored, changes, keep)
    # a request that a stored token covers opens none, whatever else does
    able = requests.where("valid").join(whole, _GROUP, "left_anti").withColumn("end", F.lit(None).cast("long"))
    partly = stored_spans.join(whole, _GROUP, "left_anti")
    able = keep(_free(able, partly, "auto").drop("end"), "able")
    spans, strategy = _spans(requests, asks.join(able, "uid", "left_semi"), whole, changes, issued_base, keep)
    ends = spans.where("home and first").groupBy("uid").agg(F.min("off").alias("end"))
    openers = keep(able.join(ends, "uid").select(*_GROUP, "place", "uid", "end"), "openers")
    unchecked = asks.where("key is null and valid").select("uid", *_GROUP)
    foreign = keep(spans.where("not (home and first)"), "foreign")
    accepted, taken, touched = openers.select("uid", *_GROUP).limit(0), openers.select("uid").limit(0), None
    turn = 0
    while True:
        busy = foreign.join(accepted, "uid", "left_semi")
        able = openers.join(taken, "uid", "left_anti")

        def here(df: DataFrame, name: str, turn=turn) -> DataFrame:
            return keep(df, f"{turn}-{name}")

        if touched is not None:
            busy, able = (x.join(touched, _GROUP, "left_semi") for x in (busy, able))
        now = _chain(_free(able, busy, strategy), here, strategy)
        if touched is not None:
            now = now.unionByName(accepted.where("key is not null").join(touched, _GROUP, "left_anti").select("uid", *_GROUP))
        now = here(now.unionByName(unchecked.join(taken, "uid", "left_anti").select("uid", *_GROUP)), "accepted")
        flips = here(_flips(accepted, now), "flips")
        if flips.isEmpty():
            break
        accepted, turn = now, turn + 1
        held, taken = taken, here(_taken(accepted, asks), "taken")
        # keys and days whose other cover, or whose requests that can open a token, have changed
        touched = here(foreign.join(flips, "uid", "left_semi").select(*_GROUP).unionByName(
            openers.join(_flips(held, taken), "uid", "left_semi").select(*_GROUP)).distinct(), "touched")
    covering = stored_spans.unionByName(spans.join(accepted, "uid", "left_semi").select(*spans.columns))
    largest = requests.agg(F.max("place")).first()[0] or 0
    refused = requests.join(accepted, "uid", "left_anti").join(taken, "uid", "left_anti")
    blocked = _blockers(refused, covering, largest)
    out = asks.select("uid", "kind", account.alias("by_account")).join(
        accepted.select("uid", F.lit(True).alias("admitted")), "uid", "left").join(
        taken.withColumn("taken", F.lit(True)), "uid", "left").join(blocked, "uid", "left")
    no = F.lit(False)
    return out.select("uid", "kind", F.coalesce("admitted", no).alias("admitted"), F.coalesce("taken", no).alias("taken"),
                      "by_account", F.when(F.col("blocker").isNotNull(), F.when(F.col("blocker.lab"), "lab").otherwise("opd"))
                      .alias("blocker_kind"), F.col("blocker.token_id").alias("blocker_token_id"),
                      F.col("blocker.status").alias("blocker_status"))


def refusal_text(kind: str, by_account: Column, blocker_kind: Column, number: Column, status: Column) -> Column:
    """The endpoint's own words for a refused request (null without a blocker)."""
    def label(names: dict) -> Column:
        return F.when(blocker_kind == "opd", F.lit(names["opd"])).otherwise(F.lit(names["lab"]))

    parts = {"kind": label(KIND_LABEL), "place": label(PLACE_LABEL), "token": number,
             "status": F.concat(F.upper(F.substring(status, 1, 1)), status.substr(F.lit(2), F.length(status)))}

    def fill(template: str) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            head, rest = rest.split("{", 1)
            name, rest = rest.split("}", 1)
            pieces += [F.lit(head), parts[name]]
        return F.concat(*pieces, F.lit(rest))

    return F.when(blocker_kind.isNotNull(), F.when(by_account, fill(REFUSALS[kind, True])).otherwise(
        fill(REFUSALS[kind, False])))
