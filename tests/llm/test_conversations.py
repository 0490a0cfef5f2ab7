"""Conversation repair against a plain search over all edits, with slices of a few rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from obsfuse.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies bigint"
SPACES, LEGAL = " \t\n\x0b\x0c\r", {"su", "ua", "au"}


def plain(rows: list[tuple[str, str]], known: list | None = None) -> tuple[int, str, str, list[str | None], int]:
    """Cost, audit and repaired text of rows ``(role, text)``, their faults, and illegal neighbours."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    faults = known or faults
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i: int, state: int, inserted: int) -> tuple[int, str, tuple]:
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 2:
            for letter in "ua":
                if letter in step[state]:
                    c, a, t = best(i, step[state][letter], inserted + 1)
                    options.append((c + 5, "I" + a, (names[letter] + ":", *t)))
        if i < len(rows):
            role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            options.append((c + 2, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if role[:1] in step[state]:
                    c, a, t = best(i + 1, step[state][role[:1]], 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                for letter in "ua":
                    if letter in step[state]:
                        c, a, t = best(i + 1, step[state][letter], 0)
                        options.append((c + more + 1, "R" + a, (f"{names[letter]}:{text}", *t)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    cost, audit, said = best(0, 0, 0)
    odd = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return cost, audit, "\n".join(said), faults, odd


def ordered(rows: list[tuple]) -> dict:
    """Rows of each conversation after copies, by turn; nothing else may tell rows of one turn apart here."""
    out: dict = {}
    for conv, turn, role, text, copies in rows:
        out.setdefault(conv, []).extend([(turn, role if role is not None else " ", text if text is not None else " ")] * copies)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def expected(rows: list[tuple]) -> dict:
    out = {}
    for conv, said in ordered(rows).items():
        if not said:
            continue
        cost, audit, text, faults, odd = plain([r[1:] for r in said])
        turns = [r[0] for r in said if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), odd, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def some_rows(seed: int, convs: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(0, most)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["", " \n", None, "Yes.", "Why?", "cut off", "Go! \t", f"n {turn}.", f"m {turn}", f"o {turn}."])
            if rng.random() < 0.9:
                rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if turn or rng.random() < 0.8 else None, role, text, rng.choice([1, 1, 1, 1, 2, 0, 3])))
    keep, taken = [], set()
    for row in rows:  # one row for a turn
        if row[:2] not in taken:
            taken.add(row[:2])
            keep.append(row)
    return keep


def repaired(spark, rows: list[tuple], slice_rows: int) -> dict:
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, place int").repartition(3)
    plans = cr.edit_plans(turns, slice_rows)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in cr.digests(cr.repaired_turns(turns, plans)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (*r[1:], hashes.get(r["conv_id"], nothing)) for r in plans.collect()}


@pytest.mark.parametrize(("seed", "convs", "most", "slice_rows"), [(1, 40, 9, 100_000), (2, 25, 9, 4), (3, 2, 60, 7), (4, 1, 40, 2)])
def test_repair_equals_plain_search(spark, seed, convs, most, slice_rows):
    rows = some_rows(seed, convs, most)
    assert repaired(spark, rows, slice_rows) == expected(rows)


def test_many_equal_rows_and_rows_of_one_turn(spark):
    rows = [(1, None, "user", "Hi.", 60), (1, 3, "assistant", "Yo.", 1), (1, 9, "user", "Hi.", 50), (2, 1, "user", "a.", 1), (2, 1, "assistant", "b.", 1)]
    got = repaired(spark, rows, 2)
    assert got[1] == expected(rows)[1]
    either = [expected([rows[3], (2, 1, *rows[4][2:])])[2], expected([rows[4], rows[3]])[2]]
    assert got[2] in either


def test_edges(spark):
    rows = [(1, 0, "user", "x" * 300_000 + ".", 1), (1, 1, "assistant", "Y.", 1), (2, 0, "user", "a.", 0), (3, 0, "system", "S.", 1)]
    assert repaired(spark, rows, 100) == expected(rows)
    assert repaired(spark, [(5, 1, "user", "a", 0)], 100) == {}
    assert cr.edit_plans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paths_are_the_least_of_the_cheapest():
    rng = np.random.default_rng(3)
    n = 400
    conv = np.sort(rng.integers(0, 60, n))
    code, copies, fault = rng.integers(0, 4, n), rng.integers(1, 3, n), rng.integers(0, 4, n)
    place = np.arange(n)
    table = pa.table({"conv_id": conv, "turn": place, "h1": place, "h2": place, "code": code, "copies": copies, "fault": fault})
    part = cr.Slice(table)
    text = {cr.BLANK: "", cr.DUPLICATE: "d.", cr.TRUNCATED: "cut", cr.FINE: "end."}
    for c, entry, _, cost, audit in part.paths({}):
        rows, faults = [], []
        for i in np.flatnonzero(conv == part.convs[c]).tolist():
            rows += [("tsua"[code[i]], text[fault[i]])] * int(copies[i])
            faults += [[None, "blank", "duplicate", "truncated"][fault[i]]] + ["duplicate"] * int(copies[i] - 1)
        assert (entry, cost, audit.decode()) == (cr.START, *plain(rows, faults)[:2])


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out.append((conv, turn, "user" if draw == 4 else role, text, {0: 0, 3: 2}.get(draw, 1)))
    return out


def test_registered_query_over_a_folder(spark, tmp_path):
    from obsfuse.llm.queries import QUERIES

    rows = [r[:4] for r in some_rows(9, 80, 9)] + [(1000, 5, "user", "gone.")]
    dropped = next(i for i in range(2000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "all of it."))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    assert got == want | expected(damaged(rows))
    assert got[dropped] == want[dropped]
