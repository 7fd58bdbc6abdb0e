"""Legal status changes against a walk in plain Python, as a batch and as streams."""

import random
from datetime import datetime, timedelta

import pytest

from piiloom import rules as R
from piiloom.operators import states
from piiloom.session import shared_folder
from piiloom.streaming.run import read_changes, read_states, read_stream, track_statuses

SCHEMA = "doc_id string, ts timestamp_ntz, seq long, status string, part int, state string"


def changes(n, seed=4):
    """Of one hot document, some others, one without an id, with ties and odd statuses."""
    rng = random.Random(seed)
    start, out = datetime(2024, 1, 1), []
    for i in range(n):
        doc = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
        status = rng.choice([*R.STATUSES, None, "ODD"]) if rng.random() < 0.9 else "PENDING"
        out.append((doc, start + timedelta(minutes=rng.randrange(n // 3 + 1)), i, status, 1, "clash"))
    return out


def walked(rows):
    now, out = {}, set()
    for doc, ts, seq, status, *_ in sorted(rows, key=lambda r: r[1:3]):
        state = now.get(doc, states.NEW)
        good = status in R.NEXT_STATUSES.get(state, ())
        out.add((doc, ts, seq, status, state, good))
        if good:
            now[doc] = status
    return out, now


def rows_of(df):
    return [(r["doc_id"], r["ts"], r["seq"], r["status"], r["from_status"], r["accepted"]) for r in df.collect()]


@pytest.mark.parametrize("block", [3, 500])
def test_batch_equals_walk(spark, monkeypatch, block):
    monkeypatch.setattr(states, "BLOCK", block)
    rows = changes(600)
    checked = states.check_transitions(spark.createDataFrame(rows, SCHEMA))
    want, now = walked(rows)
    got = rows_of(checked)
    assert len(got) == len(rows) and set(got) == want
    assert {r["doc_id"]: r["status"] for r in states.last_accepted(checked).collect()} == now


def test_repeated_rows_and_empty_table(spark):
    at = datetime(2024, 1, 1)
    twice = spark.createDataFrame([("a", at, 1, "PENDING", 0, "")] * 2, SCHEMA)
    assert sorted(r["accepted"] for r in states.check_transitions(twice).collect()) == [False, True]
    assert states.check_transitions(twice.limit(0)).count() == 0


def test_streams_in_order_of_time_equal_the_batch(spark):
    rows = changes(200)
    root = shared_folder(spark, "test-states")
    middle = sorted(r[1] for r in rows)[100]
    for name, part in (("one", [r for r in rows if r[1] < middle]), ("two", [r for r in rows if r[1] >= middle])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{root}/{name}")
        for again in ("", "-again"):  # the same batch delivered twice counts once
            track_statuses(read_stream(spark, f"{root}/{name}"), f"{root}/table", f"{root}/cp-{name}{again}",
                           name=name).awaitTermination()
    want, now = walked(rows)
    got = rows_of(read_changes(spark, f"{root}/table"))
    assert len(got) == len(rows) and set(got) == want
    assert {r["doc_id"]: r["status"] for r in read_states(spark, f"{root}/table").collect()} == now
    assert any(not r[5] for r in got)
