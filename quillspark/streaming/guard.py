"""The degeneration guard while tokens arrive: one answer for each stream of tokens, whatever the micro-batches.

State is kept by stream: the last tokens, how many have been seen, and steps that came before an earlier one. The answer comes with the
first step that stops a stream; a stream that nothing stops is answered by a timer, when the watermark is ``idle`` past its last step.
The answers are those of ``operators.guard.first_trigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.guard import KEEP, MAX_PERIOD

#: The session must keep state in this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ends_in_cycle(tokens: list, longest: int = MAX_PERIOD) -> bool:
    """Whether a list ends in three repetitions of a run of ``longest`` elements or fewer."""
    n = len(tokens)
    return any(n >= 3 * p and tokens[n - 2 * p :] == tokens[n - 3 * p : n - p] for p in range(1, longest + 1))


class _Guard(StatefulProcessor):
    def __init__(self, timeout_ms: float, max_tokens: int, idle_ms: int):
        self.timeout_ms, self.max_tokens, self.idle_ms = timeout_ms, max_tokens, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, last long, latest long, answered boolean, recent array<long>")
        self.early = handle.getMapState("early", "step long", "token long, ms double, aborted boolean")

    def _take(self, state: dict, step: int, token, ms: float, aborted: bool) -> str | None:
        """Counts a step and says whether it stops the stream."""
        state["n"], state["last"] = state["n"] + 1, step
        state["recent"] = [*state["recent"], token][-KEEP:]
        return "aborted" if aborted else "timeout" if ms > self.timeout_ms else "repetition" if ends_in_cycle(state["recent"]) else None

    def _row(self, key, at: int, reason: str | None) -> pd.DataFrame:
        return pd.DataFrame({"gen_id": [key[0]], "stopped_at": [at], "reason": [reason]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.seen.get()
        state = {"n": 0, "last": 0, "latest": 0, "answered": False, "recent": []} if held is None else {"n": held[0], "last": held[1], "latest": held[2], "answered": held[3], "recent": list(held[4])}
        arrived = {}
        for part in rows:
            for step, token, ms, aborted, at in zip(part["step"], part["token"], part["ms"], part["aborted"], part["ts"], strict=True):
                state["latest"] = max(state["latest"], int(pd.Timestamp(at).timestamp() * 1000))
                if int(step) > state["last"]:
                    arrived[int(step)] = (int(token), float(ms), bool(aborted))
        if not state["answered"]:
            for step in sorted(arrived):
                if step != state["last"] + 1:
                    self.early.updateValue((step,), arrived[step])
                    continue
                following = arrived[step]
                while following is not None and not state["answered"]:
                    at = state["last"] + 1
                    if reason := self._take(state, at, *following):
                        state["answered"] = True
                        self.early.clear()
                        yield self._row(key, at, reason)
                    elif at + 1 in arrived:
                        break  # its turn comes
                    else:
                        following = self.early.getValue((at + 1,)) if self.early.containsKey((at + 1,)) else None
                        if following is not None:
                            self.early.removeKey((at + 1,))
                if state["answered"]:
                    break
        self.seen.update((state["n"], state["last"], state["latest"], state["answered"], state["recent"]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state["latest"] + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.seen.get()
        if held is not None and not held[3]:
            state = {"n": held[0], "last": held[1], "recent": list(held[4])}
            reason = None
            # steps behind one that never came
            for step, waiting in sorted((k[0], v) for k, v in self.early.iterator()):
                if step > state["last"] and (reason := self._take(state, step, *waiting)):
                    break
            at = state["last"] if reason else state["n"]
            yield self._row(key, at, reason or ("max_tokens" if state["n"] >= self.max_tokens else None))
        self.seen.clear()
        self.early.clear()

    def close(self) -> None:
        pass


def online_triggers(steps: DataFrame, timeout_ms: float, max_tokens: int, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(gen_id, stopped_at, reason) of the stream ``steps(gen_id, step, token, ms, aborted, ts)``, one row for each gen_id.

    Steps count from 1 and may come in any order and in any micro-batches, repeated ones count once. ``late`` is how far ``ts`` may lag
    behind the latest; a stream without steps for ``idle`` beyond that is over.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = dict(steps.dtypes)["gen_id"]
    d = steps.select("gen_id", "step", "token", "ms", "aborted", "ts").withWatermark("ts", late)
    return d.groupBy("gen_id").transformWithStateInPandas(statefulProcessor=_Guard(timeout_ms, max_tokens, idle_ms), outputStructType=f"gen_id {kind}, stopped_at long, reason string", outputMode="Append", timeMode="EventTime")
