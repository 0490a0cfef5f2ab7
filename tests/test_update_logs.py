"""Verdicts on whole update logs against a plain walk."""

from __future__ import annotations

import random

import pytest

from obsfuse.operators.update_logs import admit_log
from obsfuse.streaming.admission import admit_bias

SCHEMA = "stream_id string, update_id string, start long, stop long, identity string, rows long"


def walk(log, rule):
    """The rules, one update after the other."""
    out, state, ids = {}, {}, set()
    for i, (_, u, start, stop, identity, rows) in sorted(log, key=lambda x: (x[1][2], x[1][3], x[1][1])):
        if rule == "bias":
            before = state.get("rows", 0)
            state, why = admit_bias(state, {"update_id": u, "start": start, "stop": stop, "identity": identity, "rows": rows})
            out[i] = (why, None if why else before)
            continue
        why = None
        if u in ids:
            why = "repeated-update"
        elif stop <= start:
            why = "empty-interval"
        elif state:
            if start != state["stop"]:
                why = "reopened-interval" if start < state["stop"] else "gap"
            elif identity != state["identity"]:
                why = "identity-changed"
        if why is None:
            state = {"stop": stop, "identity": identity}
            ids.add(u)
        out[i] = (why, None if why else 0)
    return out


@pytest.mark.parametrize("rule", ["interval", "bias"])
def test_log_equals_walk(spark, rule):
    rng = random.Random(7)
    data, number = [], 0
    for s, n in (("a", 60), ("b", 12), ("c", 1), ("d", 25)):
        at = 0
        for _ in range(n):
            start = at if rng.random() < 0.7 else max(0, at + rng.randint(-2, 2))
            stop = start + rng.choice([0, 1, 1, 1, 2])
            # ids repeat now and then; the number of rows tells each row
            u = f"u{rng.randint(0, 40):03d}" if rng.random() < 0.2 else f"v{number:03d}"
            data.append((s, u, start, stop, "m" if rng.random() < 0.9 else "n", number))
            at, number = max(at, stop), number + 1
    got = admit_log(spark.createDataFrame(data, SCHEMA).repartition(5), rule).collect()
    assert len(got) == len(data)
    want = []
    for s in "abcd":
        log = [(i, r) for i, r in enumerate(data) if r[0] == s]
        for i, (why, first) in walk(log, rule).items():
            want.append((*data[i][:4], why, first))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.stream_id, r.update_id, r.start, r.stop, r.reason, r.row_start) for r in got), key=key) == sorted(want, key=key)
    assert all(r.admitted == (r.reason is None) for r in got)


def test_log_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert admit_log(empty).count() == 0
    odd = [(None, None, 0, 1, None, None), (None, "x", 1, 2, None, 3), ("s", "y", None, 4, "m", 1), ("s", "z", 5, 5, "m", 1)]
    got = {(r.stream_id, r.update_id): (r.reason, r.row_stop) for r in admit_log(spark.createDataFrame(odd, SCHEMA), "bias").collect()}
    assert got == {(None, None): (None, 0), (None, "x"): (None, 3), ("s", "y"): ("empty-interval", None), ("s", "z"): ("empty-interval", None)}
