"""Verdicts on agent trails while they are walked: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.journeys import BLOCKED, BROKEN, SEVERITY, THIN_WORDS

COUNTERS = ("steps", "fetches", "searches", "readable", "blocked", "broken", "ms", "slowest_ms", "bytes", "blockers", "friction")
VERDICT = f"journey_id string, n int, at timestamp, state string, outcome string, {', '.join(f'{c} long' for c in COUNTERS)}"
_STATE = f"n int, at long, sealed boolean, answered boolean, proven boolean, {', '.join(f'{c} long' for c in COUNTERS)}, seen array<string>, taken array<int>"


def keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs a state store that can hold several values a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Trail:
    """A journey so far: counters, the (code, url) pairs counted, the numbers of the steps taken. No page text."""

    def __init__(self, saved: tuple | None = None):
        if saved is None:
            self.n, self.at, self.sealed, self.answered, self.proven = 0, 0, False, False, False
            self.count, self.seen, self.taken = dict.fromkeys(COUNTERS, 0), set(), set()
        else:
            self.n, self.at, self.sealed, self.answered, self.proven, *rest = saved
            self.count, self.seen, self.taken = dict(zip(COUNTERS, rest, strict=False)), set(rest[-2]), set(rest[-1])

    def saved(self) -> tuple:
        return (self.n, self.at, self.sealed, self.answered, self.proven, *self.count.values(), sorted(self.seen), sorted(self.taken))

    def met(self, code: str, url: str) -> None:
        """A code counts once per url."""
        key = f"{code}|{url}"
        if key not in self.seen:
            self.seen.add(key)
            kind = {"blocker": "blockers", "friction": "friction"}.get(SEVERITY.get(code))
            if kind:
                self.count[kind] += 1

    def take(self, step: dict) -> bool:
        """Add a step; false if it was taken before or comes after the end."""
        if self.sealed or step["n"] in self.taken:
            return False
        self.taken.add(step["n"])
        self.n, self.at = max(self.n, step["n"]), max(self.at, step["at"])
        c, codes = self.count, step["issues"]
        for code in codes:
            self.met(code, step["final_url"] or step["url"])
        c["steps"] += 1
        if step["action"] == "fetch":
            c["fetches"] += 1
            c["readable"] += step["status"] is not None and step["status"] < 400 and step["words"] >= THIN_WORDS and "javascript_only" not in codes
            c["blocked"] += any(x in BLOCKED for x in codes)
            c["broken"] += any(x in BROKEN for x in codes)
            c["ms"] += step["ms"]
            c["slowest_ms"] = max(c["slowest_ms"], step["ms"])
            c["bytes"] += step["bytes"]
        c["searches"] += step["action"] == "search"
        self.proven |= step["verified"] or step["custom"]
        self.answered |= step["action"] == "answer"
        gave_up = step["action"] == "giveup"
        if gave_up and not self.answered and c["readable"]:
            self.met("no_route", "")
        if step["exhausted"] and not self.answered:
            self.met("budget_exhausted", "")
        self.sealed = self.answered or gave_up or step["exhausted"]
        return True

    @property
    def outcome(self) -> str:
        if not self.count["readable"]:
            return "blocked"
        return ("completed" if self.proven else "partial") if self.answered else "stalled"


class Verdicts(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("trail", _STATE)

    def _row(self, key: tuple, trail: _Trail, state: str) -> list:
        return [key[0], trail.n, pd.Timestamp(trail.at, unit="us"), state, trail.outcome, *trail.count.values()]

    def _wait(self, at_us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_us // 1000 + self.timeout_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        trail = _Trail(self.state.get() if self.state.exists() else None)
        out, steps = [], []
        for part in rows:
            part = part.assign(at=part["ts"].astype("datetime64[us]").astype("int64"))
            steps += part.to_dict("records")
        for step in sorted(steps, key=lambda s: s["n"]):
            step["issues"] = [] if step["issues"] is None else list(step["issues"])
            step["status"] = None if pd.isna(step["status"]) else int(step["status"])
            for name in ("words", "ms", "bytes"):
                step[name] = 0 if pd.isna(step[name]) else int(step[name])
            if trail.take(step):
                out.append(self._row(key, trail, "sealed" if trail.sealed else "walking"))
        if out:
            self.state.update(trail.saved())
            self._wait(trail.at)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in VERDICT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            trail = _Trail(self.state.get())
            self.state.clear()
            if not trail.sealed:
                yield pd.DataFrame([self._row(key, trail, "expired")], columns=[f.split()[0] for f in VERDICT.split(", ")])

    def close(self) -> None:
        pass


def live_verdicts(steps: DataFrame, timeout: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """The verdict after each step of a stream of ``steps``, as rows of ``VERDICT``.

    ``steps``: journey_id, ts, n, action, url, final_url, status, ms, bytes, words, issues, and the flags verified, custom
    and exhausted, which may be missing. A journey is ``walking`` until an answer, a give-up or an exhausted budget seals
    it; one without a step for ``timeout`` of event time is closed as ``expired``, with the outcome that it had. Steps of
    a batch are taken in the order of n; a step that comes again (same n) or after the seal changes nothing. Null
    numbers count 0, null urls are empty, null flags are false; steps without journey_id, ts or n are left out. The last
    row of a sealed journey equals ``journey_metrics`` and ``issue_counts`` of its steps.
    """
    spark = steps.sparkSession
    keyed_state(spark)
    flag = lambda name: (F.coalesce(F.col(name), F.lit(False)) if name in steps.columns else F.lit(False)).alias(name)
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    rows = steps.select(
        "journey_id", "ts", F.col("n").cast("int").alias("n"), text("action"), text("url"), text("final_url"), F.col("status").cast("long").alias("status"),
        *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("ms", "bytes", "words")), "issues", flag("verified"), flag("custom"), flag("exhausted"),
    ).where("journey_id IS NOT NULL AND ts IS NOT NULL AND n IS NOT NULL")
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return rows.withWatermark("ts", late).groupBy("journey_id").transformWithStateInPandas(Verdicts(millis), VERDICT, "Append", "EventTime")


class Paced(StatefulProcessor):
    """Lets a record's states through once in a while, and all that end it."""

    def __init__(self, every_ms: int, columns: list[str]):
        self.every_ms, self.columns = every_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("written", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True).sort_values(["paced_ms", "paced_end"], kind="stable")
        last, keep = self.last.get()[0] if self.last.exists() else None, []
        for at, end in zip(part["paced_ms"], part["paced_end"], strict=True):
            keep.append(bool(end) or last is None or at - last >= self.every_ms)
            if keep[-1]:
                last = None if end else int(at)
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        yield part.loc[keep, self.columns]

    def close(self) -> None:
        pass


def paced(states: DataFrame, key: str = "id", at: str = "ts", status: str = "status", ends: tuple[str, ...] = ("complete", "partial", "failed"), every: str = "15 seconds") -> DataFrame:
    """A stream of ``states`` without those that come within ``every`` of the last one let through for their key.

    A status in ``ends`` always passes, and the next state after it does. States of a batch are taken in the order of ``at``,
    endings last; rows without key or time are left out.
    """
    keyed_state(states.sparkSession)
    millis = int(pd.Timedelta(every).total_seconds() * 1000)
    rows = states.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumns({
        "paced_ms": F.unix_millis(F.col(at).cast("timestamp")), "paced_end": F.coalesce(F.col(status).isin(*ends), F.lit(False)),
    })
    return rows.groupBy(key).transformWithStateInPandas(Paced(millis, states.columns), states.schema, "Append", "None")
