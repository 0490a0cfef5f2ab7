"""Keyed fixed-lag gauge state for a stream of alignment edges."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from obsfuse.functions import sim3
from obsfuse.operators.gauges import relative_factor, smooth_fixed_lag

GAUGE_OUTPUT = f"case_id string, window_id string, position int, {sim3.GAUGE_SCHEMA}, cov array<double>"
_NAMES = [c.strip().split()[0] for c in GAUGE_OUTPUT.split(",")]


class RollingGauges(StatefulProcessor):
    """Holds the last ``lag`` gauges of a case and emits a gauge when its window closes.

    Edges arrive in window order.  A window closes once ``lag`` later windows exist; its
    estimate is then final, because no admitted factor may span beyond the lag.
    """

    def __init__(self, lag: int) -> None:
        self.lag = lag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gauges", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"names": {}, "edges": [], "base": 0, "gauges": [], "emitted": 0}
        batch = pd.concat(list(rows)).sort_values(["moving_position", "reference_position"])
        for r in batch.to_dict("records"):
            for side in ("reference", "moving"):
                s["names"][str(int(r[f"{side}_position"]))] = r[f"{side}_id"]
            t = sim3.unpack(r)
            s["edges"].append([int(r["reference_position"]), int(r["moving_position"]), t[0], t[1].ravel().tolist(), t[2].tolist(), list(r["cov"])])
        top = max(int(k) for k in s["names"])
        base = s["base"]
        gauges = [((g[0], np.array(g[1]).reshape(3, 3), np.array(g[2])), sim3.square(g[3])) for g in s["gauges"]]
        if not gauges:
            gauges = [(sim3.IDENTITY, np.diag([1e-10] * 7))]
        factors = []
        for a, b, sc, rot, tr, cov in s["edges"]:
            t, c = (sc, np.array(rot).reshape(3, 3), np.array(tr)), sim3.square(cov)
            factors.append(relative_factor(a - base, b - base, t, c))
            if b - base == len(gauges) and a - base < len(gauges):
                gauges.append(sim3.compose_cov(*gauges[a - base], t, c))
        gauges = smooth_fixed_lag(gauges, factors, max(self.lag, 2)) if len(gauges) > 1 else gauges
        closed = max(0, min(top - self.lag + 1, base + len(gauges)) - s["emitted"])
        out = []
        for k in range(closed):
            i = s["emitted"] + k
            t, c = gauges[i - base]
            out.append({"case_id": key[0], "window_id": s["names"][str(i)], "position": i, **sim3.pack(t), "cov": c.ravel().tolist()})
        s["emitted"] += closed
        drop = max(0, s["emitted"] - 1 - base)  # keep the last closed gauge as the boundary prior
        s["base"] = base + drop
        s["edges"] = [e for e in s["edges"] if e[0] >= s["base"] and e[1] >= s["base"]]
        s["gauges"] = [[t[0], t[1].ravel().tolist(), t[2].tolist(), c.ravel().tolist()] for t, c in gauges[drop:]]
        s["names"] = {k: v for k, v in s["names"].items() if int(k) >= s["base"]}
        self.state.update((json.dumps(s),))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass
