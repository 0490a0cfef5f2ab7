"""Append-only stream admission with keyed state.

Each stream key owns a small state (last causal stop, last update id, identity, offsets).
An update is admitted, or refused with a reason; late or conflicting data are never
merged.  Batch form (`admit_batch`) and streaming form share the same rules.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "stream_id string, update_id string, start bigint, stop bigint, admitted boolean, reason string,"
    " chain_id string, row_start bigint, row_stop bigint"
)
_STATE = "payload string"


def chain_hash(previous: str | None, content: str) -> str:
    return hashlib.sha256(f"{previous or ''}|{content}".encode()).hexdigest()


def admit_interval(state: dict, row: dict) -> tuple[dict, str | None]:
    """Next update must start exactly at the previous causal stop; identity is fixed."""
    if row["update_id"] in state.get("ids", []):
        return state, "repeated-update"
    if row["stop"] <= row["start"]:
        return state, "empty-interval"
    if state.get("stop") is not None:
        if row["start"] < state["stop"]:
            return state, "reopened-interval"
        if row["start"] > state["stop"]:
            return state, "gap"
        if row.get("identity") != state["identity"]:
            return state, "identity-changed"
    # ids admitted earlier end before the stop, so a short tail of ids is enough
    return {**state, "stop": row["stop"], "identity": row.get("identity"), "ids": [row["update_id"]]}, None


def admit_identity(state: dict, row: dict) -> tuple[dict, str | None]:
    """One new window per update, from admitted sources, one causal stop, no repeats.

    ``identity`` is the target window; ``sources`` the source windows; ``stops`` their
    causal stops.
    """
    known = state.get("windows")
    sources = list(row.get("sources") if row.get("sources") is not None else [])
    stops = list(row.get("stops") if row.get("stops") is not None else [])
    if known is None:
        return {"windows": [row["identity"]]}, None
    if row["identity"] in known:
        return state, "target-already-admitted"
    if not sources:
        return state, "no-association"
    if len(set(sources)) != len(sources):
        return state, "repeated-source"
    if not set(sources) <= set(known):
        return state, "source-not-admitted"
    if len(set(stops)) > 1:
        return state, "causal-stop-differs"
    return {"windows": [*known, row["identity"]]}, None


def admit_bias(state: dict, row: dict) -> tuple[dict, str | None]:
    """Same model, interval after everything retained, unique update id, running offsets."""
    if row["stop"] <= row["start"]:
        return state, "empty-interval"
    if state.get("stop") is not None:
        if row.get("identity") != state["identity"]:
            return state, "model-changed"
        if row["update_id"] in state["ids"]:
            return state, "repeated-update"
        if row["start"] < state["stop"]:
            return state, "overlaps-retained"
    return {
        "stop": row["stop"],
        "identity": row.get("identity"),
        "ids": [*state.get("ids", []), row["update_id"]],
        "rows": state.get("rows", 0) + int(row.get("rows") or 0),
    }, None


def admit_decision(state: dict, row: dict) -> tuple[dict, str | None]:
    """At most one decision per target group, for the frozen candidate only."""
    if state.get("done"):
        return state, "group-already-decided"
    if row.get("identity") != row.get("candidate"):
        return state, "candidate-changed"
    if not row.get("accepted") and not row.get("exact_fallback"):
        return state, "fallback-not-reproduced"
    return {"done": True}, None


RULES: dict[str, Callable[[dict, dict], tuple[dict, str | None]]] = {
    "interval": admit_interval,
    "identity": admit_identity,
    "bias": admit_bias,
    "decision": admit_decision,
}


def _apply(rule: str, state: dict, rows: list[dict]) -> tuple[dict, list[tuple]]:
    out = []
    for row in rows:
        inner, why = RULES[rule](state.get("rule", {}), row)
        first = state.get("rule", {}).get("rows", 0)
        if why is None:
            state = {"rule": inner, "chain": chain_hash(state.get("chain"), str(row.get("content_hash")))}
        out.append(
            (row["stream_id"], row["update_id"], row.get("start"), row.get("stop"), why is None, why,
             state.get("chain") if why is None else None, first if why is None else None,
             state["rule"].get("rows", 0) if why is None else None)
        )
    return state, out


_COLUMNS = [c.strip().split()[0] for c in OUTPUT.split(",")]


def _ordered(pdf: pd.DataFrame) -> list[dict]:
    cols = [c for c in ("start", "stop", "update_id") if c in pdf.columns]
    return pdf.sort_values(cols).to_dict("records")


class Admission(StatefulProcessor):
    """Keyed processor for one rule; state is one small JSON document per stream."""

    def __init__(self, rule: str) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("admission", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        current = json.loads(self.state.get()[0]) if self.state.exists() else {}
        batch = pd.concat(list(rows))
        current, out = _apply(self.rule, current, _ordered(batch))
        self.state.update((json.dumps(current),))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def admit_stream(updates: DataFrame, rule: str = "interval") -> DataFrame:
    """Streaming admission of ``updates`` (stream_id, update_id, start, stop, ...).

    Needs the RocksDB state store provider.  Rows of one micro-batch are ordered by
    (start, stop, update_id) per stream before they are judged.
    """
    return updates.groupBy("stream_id").transformWithStateInPandas(
        Admission(rule), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def admit_batch(updates: DataFrame, rule: str = "interval") -> DataFrame:
    """The same rules over a complete table; one stream's updates are one bounded log."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_apply(rule, {}, _ordered(pdf))[1], columns=_COLUMNS)

    return updates.groupBy("stream_id").applyInPandas(run, OUTPUT)


IDENTITY = (
    "stream_id string, update_id string, target string, position bigint, admitted boolean, reason string, hypotheses bigint, chain_id string"
)


class IdentityAdmission(StatefulProcessor):
    """Updates that each add one window, linked from windows of the stream that were admitted before.

    The admitted windows are a map state with their causal stops, one entry each, so an update touches only
    the entries that it names, however many there are.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "window string", "stop bigint")
        self.head = handle.getValueState("head", "chain string, stop bigint")

    def _refusal(self, target: str, sources: list[str], stops: list[int], begun: bool, last: int | None) -> str | None:
        if not begun and not sources:
            return None  # the root window
        if begun and self.windows.containsKey((target,)):
            return "target-already-admitted"
        if not sources:
            return "no-association"
        if len(set(sources)) != len(sources):
            return "repeated-source"
        if not begun or not all(self.windows.containsKey((s,)) for s in sources):
            return "source-not-admitted"
        if len(set(stops)) != 1:
            return "causal-stop-differs"
        if last is not None and stops[0] < last:
            return "causal-stop-decreases"
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        chain, last = self.head.get() if self.head.exists() else (None, None)
        begun, out = self.head.exists(), []
        for row in pd.concat(list(rows)).sort_values(["position", "update_id"]).to_dict("records"):
            sources, stops = (list(row[c]) if row[c] is not None else [] for c in ("sources", "stops"))
            why = self._refusal(row["target"], sources, [int(s) for s in stops], begun, last)
            if why is None:
                last = int(stops[0]) if sources else last
                chain, begun = chain_hash(chain, str(row["content_hash"])), True
                self.windows.updateValue((row["target"],), (last,))
                self.head.update((chain, last))
            admitted = why is None
            out.append((row["stream_id"], row["update_id"], row["target"], row["position"], admitted, why, len(sources) if admitted else None, chain if admitted else None))
        yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in IDENTITY.split(",")])

    def close(self) -> None:
        pass


def admit_identities(updates: DataFrame) -> DataFrame:
    """Streaming admission of identity hypotheses, one verdict per update.

    ``updates``: stream_id, update_id, position, target (the new window), sources and stops (the windows it is
    linked from, with their causal stops), content_hash.  The first update without sources opens a stream.  Rows of
    one micro-batch are judged by position; ids that were admitted are never rewritten.
    """
    return updates.groupBy("stream_id").transformWithStateInPandas(IdentityAdmission(), outputStructType=IDENTITY, outputMode="Append", timeMode="None")


def split_admission(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, quarantine)."""
    return judged.where("admitted"), judged.where("NOT admitted")


def admission_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("stream_id", F.coalesce("reason", F.lit("admitted")).alias("outcome")).agg(F.count(F.lit(1)).alias("updates"))
