"""The admission replay against a loop over small random logs."""

import datetime as dt
import random

import pytest

from wardline.operators.admission import admit
from wardline.sources.staging import written_tables

ACTIVE = {False: {"waiting", "consulting"}, True: {"waiting", "in_progress"}}
START = dt.datetime(2024, 1, 15, 8)
BASE = 1000


def replay(asks, stored, changes):
    """The endpoints' rules, one event after the other."""
    held = {(t["lab"], t["token_id"]): dict(t) for t in stored}
    done, out = set(), {}
    events = [(a["ts"], 0, a["uid"], a) for a in asks] + [(c["ts"], 1, c["id"], c) for c in changes]
    for _, step, _, e in sorted(events, key=lambda x: x[:3]):
        if step:
            if (e["lab"], e["token_id"]) in held:
                held[e["lab"], e["token_id"]]["status"] = e["status"]
            continue
        if e["booking"] in done and e["booking"] is not None:
            out[e["uid"]] = ("taken", None)
            continue
        if e["patient_id"] is not None:
            mine = [t for t in held.values() if t["patient_id"] == e["patient_id"]]
        else:
            mine = [t for t in held.values() if e["phone"] and t["phone"] == e["phone"]]
        open_ones = sorted((t["lab"], t["token_id"], t["status"]) for t in mine
                           if t["d"] == e["d"] and t["status"] in ACTIVE[t["lab"]])
        if open_ones:
            out[e["uid"]] = ("refused", open_ones[0])
        elif e["valid"]:
            out[e["uid"]] = ("admitted", None)
            key = (e["kind"] == "lab", BASE + e["uid"])
            held[key] = dict(lab=key[0], token_id=key[1], d=e["d"], patient_id=e["patient_id"], phone=e["phone"],
                             status="waiting")
            if e["booking"]:
                done.add(e["booking"])
        else:
            out[e["uid"]] = ("invalid", None)
    return out


def random_log(seed, n, people):
    rng = random.Random(seed)
    asks, changes, stored = [], [], []
    for uid in range(1, n + 1):
        ts = START + dt.timedelta(minutes=rng.randrange(2 * n))
        kind = rng.choice(["opd", "lab", "checkin"])
        asks.append(dict(uid=uid, kind=kind, ts=ts, d=ts.date(), patient_id=rng.choice([None, None, *range(people)]),
                         phone=rng.choice(["", *map(str, range(90, 90 + people))]),
                         valid=rng.random() < 0.85 or kind == "checkin",
                         booking=f"PB{rng.randrange(n // 8)}" if kind == "checkin" else None))
    for i in range(people * 2):
        stored.append(dict(lab=rng.random() < 0.4, token_id=i + 1, d=(START + dt.timedelta(days=rng.randrange(2))).date(),
                           patient_id=rng.choice([None, *range(people)]), phone=str(90 + rng.randrange(people)),
                           status=rng.choice(["waiting", "completed", "consulting", "in_progress"])))
    for i in range(2 * n):
        old = rng.random() < 0.1
        ask = rng.choice(asks)
        lab = rng.random() < 0.5 if old else ask["kind"] == "lab"
        changes.append(dict(lab=lab, token_id=rng.randrange(1, people * 2 + 1) if old else BASE + ask["uid"],
                            ts=START + dt.timedelta(minutes=rng.randrange(-30, 2 * n)), id=10_000 + i,
                            status=rng.choice(["waiting", "consulting", "in_progress", "completed", "cancelled"])))
    return asks, stored, changes


def frames(spark, asks, stored, changes):
    def frame(rows, schema):
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    return (frame(asks, "uid long, kind string, ts timestamp_ntz, d date, patient_id long, phone string, "
                        "valid boolean, booking string"),
            frame(stored, "lab boolean, token_id long, d date, patient_id long, phone string, status string"),
            frame(changes, "lab boolean, token_id long, ts timestamp_ntz, id long, status string"))


def outcome(r):
    if r.taken:
        return "taken", None
    if r.admitted:
        return "admitted", None
    if r.blocker_kind:
        return "refused", (r.blocker_kind == "lab", r.blocker_token_id, r.blocker_status)
    return "invalid", None


@pytest.mark.parametrize("seed, n, people", [(1, 300, 4), (2, 400, 12), (3, 250, 1)])
def test_admission_follows_the_log(spark, seed, n, people):
    log = random_log(seed, n, people)
    got = {r.uid: outcome(r) for r in admit(*frames(spark, *log), BASE, written_tables(spark, "admit")).collect()}
    want = replay(*log)
    assert got == want
    assert {"admitted", "refused"} <= {o for o, _ in want.values()}


def test_a_long_chain_of_one_patient(spark):
    """Each token ends before the next request: all are admitted, in a few doublings."""
    n = 200
    asks = [dict(uid=i, kind="opd", ts=START + dt.timedelta(seconds=2 * i), d=START.date(), patient_id=None, phone="9",
                 valid=True, booking=None) for i in range(n)]
    changes = [dict(lab=False, token_id=BASE + i, ts=START + dt.timedelta(seconds=2 * i + (1 if i % 3 else 3)), id=i,
                    status="completed") for i in range(n)]
    got = admit(*frames(spark, asks, [], changes), BASE, written_tables(spark, "admit")).collect()
    assert {r.uid: outcome(r) for r in got} == replay(asks, [], changes)


def test_no_requests(spark):
    assert admit(*frames(spark, [], [], []), BASE, written_tables(spark, "admit")).count() == 0


def test_a_round_replays_only_the_keys_that_something_else_covers_anew(spark):
    day = dt.date(2024, 1, 10)
    rows = [(1, "opd", dt.datetime(2024, 1, 10, 9), day, 1, "111", True, None),     # account 1 opens a token
            (2, "opd", dt.datetime(2024, 1, 10, 10), day, None, "111", True, None),  # found by its phone: refused
            (3, "opd", dt.datetime(2024, 1, 10, 11), day, 2, "222", True, None)]    # nobody asks on this phone
    asks = spark.createDataFrame(rows, "uid long, kind string, ts timestamp_ntz, d date, patient_id long, phone string, "
                                       "valid boolean, booking string")
    stored = spark.createDataFrame([], "lab boolean, token_id long, d date, patient_id long, phone string, status string")
    changes = spark.createDataFrame([], "lab boolean, token_id long, ts timestamp_ntz, id long, status string")
    write, kept = written_tables(spark, "rounds"), {}

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    out = admit(asks, stored, changes, 100, keep)
    assert {r.uid: (r.admitted, r.blocker_token_id) for r in out.collect()} == {
        1: (True, None), 2: (False, 101), 3: (True, None)}
    assert {r.key for r in kept["0-line"].collect()} == {"a:1", "p:111", "a:2"}
    assert {r.key for r in kept["1-line"].collect()} | {r.key for r in kept["1-touched"].collect()} <= {"p:111"}


def kept_tables(spark, rows, changes):
    """Outcomes of a small log and the tables that the replay wrote."""
    asks = spark.createDataFrame(rows, "uid long, kind string, ts timestamp_ntz, d date, patient_id long, phone string, "
                                       "valid boolean, booking string")
    stored = spark.createDataFrame([], "lab boolean, token_id long, d date, patient_id long, phone string, status string")
    changes = spark.createDataFrame(changes, "lab boolean, token_id long, ts timestamp_ntz, id long, status string")
    write, kept = written_tables(spark, "kept"), {}

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    return {r.uid: outcome(r) for r in admit(asks, stored, changes, 100, keep).collect()}, kept


def test_only_changes_that_a_request_can_meet_are_placed(spark):
    day = dt.date(2024, 1, 10)
    at = lambda h, m=0: dt.datetime(2024, 1, 10, h, m)
    rows = [(1, "lab", at(9), day, 1, "111", True, None), (2, "lab", at(10), day, None, "111", True, None)]
    changes = [(True, 101, at(9, 10), 1, "completed"), (True, 101, at(9, 20), 2, "cancelled"),
               (True, 101, at(9, 30), 3, "completed"), (True, 101, at(11), 4, "waiting")]
    got, kept = kept_tables(spark, rows, changes)
    assert got == {1: ("admitted", None), 2: ("admitted", None)}
    # one that changes the token's state, in front of the key's last request
    assert [(r.key, r.id) for r in kept["line"].where("ask = 0 and step = 1").collect()] == [("p:111", 1)]
    assert "placed" not in kept


def test_a_token_that_no_request_meets_replays_no_key(spark):
    day = dt.date(2024, 1, 10)
    rows = [(1, "opd", dt.datetime(2024, 1, 10, 8), day, None, "111", True, None),
            (2, "checkin", dt.datetime(2024, 1, 10, 9), day, 1, "111", True, "PB1")]   # nobody asks on this phone again
    got, kept = kept_tables(spark, rows, [(False, 101, dt.datetime(2024, 1, 10, 8, 30), 1, "completed")])
    assert got == {1: ("admitted", None), 2: ("admitted", None)}
    assert kept["0-touched"].isEmpty()


def test_what_a_stored_token_of_the_whole_day_hides_is_not_placed(spark):
    day = dt.date(2024, 1, 10)
    at = lambda h, m=0: dt.datetime(2024, 1, 10, h, m)
    asks = [dict(uid=i, kind="checkin", ts=at(9, i), d=day, patient_id=None, phone="111", valid=True, booking=f"PB{i}")
            for i in range(1, 6)]
    asks.append(dict(asks[0], uid=6, ts=at(9, 2), patient_id=1, booking="PB6"))   # the account holds no token
    stored = [dict(lab=lab, token_id=i, d=day, patient_id=None, phone="111", status=status)
              for lab, i, status in [(False, 1, "completed"), (False, 2, "waiting"), (False, 3, "consulting"), (True, 4, "waiting")]]
    changes = [dict(lab=False, token_id=3, ts=at(9, 3), id=1, status="completed"),
               dict(lab=False, token_id=1, ts=at(9, 3), id=2, status="consulting"),
               dict(lab=False, token_id=1, ts=at(9, 4), id=3, status="cancelled")]
    write, kept = written_tables(spark, "hidden"), {}

    def keep(df, name):
        kept[name] = write(df, name)
        return kept[name]

    out = admit(*frames(spark, asks, stored, changes), 100, keep)
    want = replay(asks, stored, changes)
    assert {r.uid: outcome(r) for r in out.collect()} == want
    assert want[3] == ("refused", (False, 2, "waiting")) and want[4] == ("refused", (False, 1, "consulting"))
    assert {(r.key, r.token_id) for r in kept["line"].where("ask = 0").collect()} == {("a:1", 106)}
    assert {r.token_id for r in kept["stored-line"].where("ask = 0").collect()} == {1}
