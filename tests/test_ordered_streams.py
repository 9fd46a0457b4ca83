"""Event-time state machines: any order of arrival inside the watermark gives the rows of a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keelson.streaming import ordered, streams as st, views

c = F.col
START = 1_700_000_000


def arriving(spark, tmp_path, rows, schema, time, order, parts=4, slack=600):
    """A stream over rows (seconds in column ``time``) that come in ``parts`` batches; ``order`` shuffles
    them within ``slack`` seconds."""
    draw, at = random.Random(order), schema.split(", ").index(next(x for x in schema.split(", ") if x.startswith(time + " ")))
    rows = sorted(rows, key=lambda r: r[at] + draw.uniform(0, slack))
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame([tuple(START + v if j == at else v for j, v in enumerate(r)) for r in rows[i * size : (i + 1) * size]], schema)
        part.withColumn(time, F.timestamp_seconds(time)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{order}"))
    final = schema.replace(f"{time} bigint", f"{time} timestamp")
    return spark.readStream.schema(final).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{order}"))


def lease_rows(n=160):
    draw = random.Random(3)
    return [(draw.randrange(4), draw.randrange(40_000), i, draw.randrange(3), draw.choice(["claim", "heartbeat", "claim", "release"])) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2])
def test_lease_stream_equals_batch_twin(spark, tmp_path, order):
    rows = lease_rows()
    schema = "entry bigint, ts bigint, event_id bigint, actor bigint, action string"
    last = START + max(r[1] for r in rows)
    got = st.run_to_table(ordered.lease_stream(arriving(spark, tmp_path, rows, schema, "ts", order), 1800, "15 minutes"))
    log = spark.createDataFrame([(a, START + b, *x) for a, b, *x in rows], schema).withColumn("ts", F.timestamp_seconds("ts"))
    want = views.lease_intervals(log, 1800).where(F.col("held_until") <= F.timestamp_seconds(F.lit(last - 900)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    silent = got.where("lapsed").count()
    assert silent and got.count() > 50


def test_lapse_without_a_later_event(spark, tmp_path):
    """The last claim of an entry lapses although nothing else comes for that entry."""
    rows = [(1, 100, 1, 7, "claim"), (2, 50_000, 2, 8, "claim")]
    out = st.run_to_table(ordered.lease_stream(arriving(spark, tmp_path, rows, "entry bigint, ts bigint, event_id bigint, actor bigint, action string", "ts", 1, parts=2), 1800, "1 minute")).collect()
    assert [(r["entry"], r["lapsed"], (r["held_until"] - r["held_from"]) == dt.timedelta(seconds=1800)) for r in out] == [(1, True, True)]


@pytest.mark.parametrize("order", [1, 2])
def test_slot_stream_equals_batch_twin(spark, tmp_path, order):
    draw = random.Random(8)
    rows = [(draw.randrange(3), i, draw.randrange(30_000), draw.randrange(1, 900) * 1_000_000) for i in range(150)]
    got = st.run_to_table(ordered.slot_stream(arriving(spark, tmp_path, rows, "channel bigint, entry bigint, created bigint, service bigint", "created", order), "15 minutes"))
    mark = START + max(r[2] for r in rows) - 900
    plain = spark.createDataFrame([(a, i, START + s, w // 1_000_000) for a, i, s, w in rows], "channel bigint, entry bigint, created bigint, service bigint")
    want = {(r["entry"], r["start"], r["wait"]) for r in views.serial_slots(plain).collect() if r["start"] <= mark}
    assert {(r["entry"], r["start"] // 1_000_000, r["wait"] // 1_000_000) for r in got.collect()} == want
    ahead = {(a, i): s for a, i, s, _ in rows}
    for r in got.collect():
        later = sorted((s, i) for (a, i), s in ahead.items() if a == r["channel"] and (s, i) > (ahead[a, r["entry"]], r["entry"]))
        expected = later[0][1] if later and (START + later[0][0]) * 1_000_000 < r["start"] else None
        assert r["next"] == expected


def coordination_rows():
    draw, rows = random.Random(6), []
    for event in range(3):
        for revision in range(1, 90):
            if revision % 17 == 0:
                continue  # lost
            action = draw.choice(["close", "reopen", "propose", "agree", "agree", "commit", "withdraw", "note", "propose", "commit"])
            rows.append((event, revision, revision * 300, revision - 1 - (revision % 13 == 0), action, draw.randrange(3), draw.randrange(2), draw.choice(["execution", "discussion"]), draw.choice([[], [0], [0, 1]]), draw.choice([0, 0, 0, 1])))
    return rows


def coordination_loop(rows):
    out = []
    for event in {r[0] for r in rows}:
        state = ordered.Coordination.EMPTY
        for _, revision, at, *change in sorted(r for r in rows if r[0] == event):
            gap = revision > state[0] + 1
            state, outcome = ordered.Coordination.step(state, revision, (at, *change))
            out.append((event, revision, gap, outcome, "ended" if state[1] else "active", state[2], state[3], len(state[8])))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2])
def test_coordination_stream_in_any_order(spark, tmp_path, order):
    rows = coordination_rows()
    schema = "event bigint, revision bigint, time bigint, expected bigint, action string, actor bigint, proposal bigint, target string, approvers array<bigint>, expected_phase bigint"
    tail = [(9, 1, 90 * 300 + 3600, 0, "note", 0, None, None, None, 0)]  # moves the watermark past all others
    out = st.run_to_table(ordered.coordination_stream(arriving(spark, tmp_path, rows, schema, "time", order), "15 minutes"))
    got = [tuple(r) for r in out.collect()]
    want = coordination_loop(rows)
    last_gap = max(r[1] for r in want if r[2])
    # what follows the last gap without another one is applied at once; all before it by the watermark
    assert sorted(got, key=str) == want and last_gap > 80
    assert {r[3] for r in got} == {"applied", "stale", "rejected"} and tail


def working_rows(n=250):
    draw = random.Random(12)
    return [
        (draw.randrange(2), draw.randrange(60_000), i, draw.choice(["observe"] * 6 + ["maintain", "clear"]), draw.randrange(5), f"i{draw.randrange(12)}", draw.randrange(1, 60), draw.choice([0.1, 0.5, 0.5, 1.4, -1.0]), draw.choice([None, 3_600_000_000]))
        for i in range(n)
    ]


def working_loop(rows, most_items, most_chars, most_frames):
    out = []
    for session in {r[0] for r in rows}:
        frames, items = {}, []  # items as dicts in a plain list
        for _, at, event, action, frame, name, size, activation, ttl in sorted((r for r in rows if r[0] == session), key=lambda r: (r[1], r[2])):
            gone = []
            frames[frame] = (at, event)
            if len(frames) > most_frames:
                old = sorted((v, f) for f, v in frames.items() if f != frame)[0][1]
                del frames[old]
                gone += sorted(f"{x['f']}/{x['n']}" for x in items if x["f"] == old)
                items = [x for x in items if x["f"] != old]
            mine = [x for x in items if x["f"] == frame and x["pin"]]
            if action == "clear":
                outcome, items = "cleared", [x for x in items if not (x["f"] == frame and x["pin"])]
            elif action == "maintain":
                others = [x for x in items if not (x["f"] == frame and x["pin"])]
                if mine and mine[0]["text"] == name:
                    outcome = "unchanged"
                elif len(others) + 1 > most_items or sum(x["s"] for x in others) + size > most_chars:
                    outcome = "refused"
                else:
                    outcome = "updated"
                    items = [*others, {"f": frame, "n": "", "pin": True, "a": 1.0, "c": mine[0]["c"] if mine else at, "r": at, "s": size, "t": None, "text": name}]
            else:
                same = [x for x in items if x["f"] == frame and x["n"] == name and not x["pin"]]
                a = min(1.0, max(0.0, activation))
                if same:
                    outcome = "renewed"
                    same[0]["a"], same[0]["r"] = max(same[0]["a"], a), at
                else:
                    outcome = "added"
                    items.append({"f": frame, "n": name, "pin": False, "a": a, "c": at, "r": at, "s": size, "t": ttl, "text": None})
                    while len(items) > most_items or sum(x["s"] for x in items) > most_chars:
                        loose = sorted((x for x in items if not x["pin"]), key=lambda x: (x["a"], x["r"], x["f"], x["n"]))
                        if not loose:
                            break
                        items.remove(loose[0])
                        gone.append(f"{loose[0]['f']}/{loose[0]['n']}")
            live = sum(x["f"] == frame and (not x["t"] or (x["c"] + x["t"] // 1_000_000) > at) for x in items)
            out.append((session, event, outcome, gone, len(items), sum(x["s"] for x in items), len(frames), live, at))
    return out


@pytest.mark.parametrize("order", [1, 2])
def test_working_set_against_a_loop(spark, tmp_path, order):
    rows = working_rows()
    schema = "session bigint, time bigint, event_id bigint, action string, frame bigint, item string, size bigint, activation double, ttl bigint"
    out = st.run_to_table(ordered.working_set_stream(arriving(spark, tmp_path, rows, schema, "time", order), "15 minutes", items=10, characters=250, frames=3))
    mark = max(r[1] for r in rows) - 900
    want = sorted((r[:-1] for r in working_loop(rows, 10, 250, 3) if r[-1] <= mark), key=lambda r: r[:2])
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2]) == want
    assert {r[2] for r in want} == {"added", "renewed", "updated", "unchanged", "refused", "cleared"} and any(r[3] for r in want)


def test_registered_working_set_against_the_loop(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in entry.queries()["t4_working_set_budget"](spark, folder).collect()), key=lambda r: r[:2])
    rows = []
    events = spark.read.parquet(f"{folder}/events.parquet").select(F.unix_micros(c("ts").cast("timestamp")).alias("at"), "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    for r in events.collect():
        k = r["k"]
        action = "maintain" if r["event_type"] == "purchase" else "clear" if r["event_type"] == "error" and k % 2 == 0 else "observe"
        rows.append((r["user_id"], r["at"], r["event_id"], action, k % 7, f"i{k % 23}", 10 + k % 50, min(r["value"] / 100, 1.0), 6 * 3_600_000_000 * 1_000_000 if k % 3 == 0 else None))
    mark = max(r[1] for r in rows) - 3_600_000_000
    # the loop counts in the unit of its times, here microseconds
    want = sorted((r[:-1] for r in working_loop(rows, 12, 400, 4) if r[-1] <= mark), key=lambda r: r[:2])
    assert got == want
