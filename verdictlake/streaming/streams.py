"""Streaming forms: answers folded into current facts, and usage windows with budget flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdictlake.operators import plain
from verdictlake.plans.rulesets import RuleSet

FACT = "profile_id LONG, field STRING, value DOUBLE, ts TIMESTAMP, event_id LONG, version LONG"
Fact = tuple[float | None, int, int]
VERDICT = "profile_id LONG, scheme_id STRING, verdict STRING, before STRING, version LONG"
#: Milliseconds of event time after its last answer that a profile is kept.
KEPT_MS = 30 * 86_400_000


def effective(answers: dict[str, Fact], screens: dict[str, list[str]]) -> dict[str, Fact]:
    """Answers, and a 0 for each field without answer whose screening fact is 0."""
    out = dict(answers)
    for screen, fields in screens.items():
        if screen in answers and answers[screen][0] == 0.0:
            out |= {f: (0.0, *answers[screen][1:]) for f in fields if f not in answers}
    return out


def current_facts(answers: DataFrame, screens: dict[str, list[str]] | None = None, lateness: str = "1 day") -> DataFrame:
    """Changes of facts from an answer stream (profile_id, field, value, ts, event_id), a null value being a decline.

    The latest answer by (ts, event_id) stands, whatever the order of arrival. A 0 on a screening fact sets its
    dependants to 0 where they have no answer, for as long as it is 0: that is derived from the answers each time and
    never kept, so a late answer replaces it and another answer to the screen takes it back (a null value).
    version numbers a profile's changes; a fact's last version is its current value. State is a row an answered
    field; a profile unseen past the watermark is dropped.
    """
    screens = screens or {}

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        *lists, version = state.get if state.exists else ([], [], [], [], 0)
        known = {f: (v, t, e) for f, v, t, e in zip(*lists, strict=True)}
        before = effective(known, screens)
        last = (0, 0)
        for rows in batches:
            for r in rows.sort_values(["ts", "event_id"]).itertuples():
                at = (int(r.ts.value // 1000), int(r.event_id))
                last = max(last, at)
                if r.field not in known or known[r.field][1:] <= at:
                    known[r.field] = (None if pd.isna(r.value) else float(r.value), *at)
        after = effective(known, screens)
        changed = {f: after.get(f, (None, *last)) for f in sorted(before.keys() | after.keys()) if before.get(f) != after.get(f)}
        names = sorted(known)
        state.update((names, *([known[f][i] for f in names] for i in range(3)), version + len(changed)))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 30 * 86_400_000)
        if changed:
            value, ts, event = zip(*changed.values(), strict=True)
            yield pd.DataFrame({"profile_id": [key[0]] * len(changed), "field": list(changed), "value": value, "ts": pd.to_datetime(ts, unit="us"), "event_id": event, "version": range(version + 1, version + len(changed) + 1)})

    kept = "fields ARRAY<STRING>, nums ARRAY<DOUBLE>, times ARRAY<LONG>, ids ARRAY<LONG>, version LONG"
    return answers.withWatermark("ts", lateness).groupBy("profile_id").applyInPandasWithState(fold, FACT, kept, "update", GroupStateTimeout.EventTimeTimeout)


class _Verdicts(StatefulProcessor):
    """A profile's answers and verdicts as maps in the state store; an event-time timer drops a profile that stays silent."""

    def __init__(self, rule_sets: list[RuleSet], screens: dict[str, list[str]]) -> None:
        self.rule_sets, self.screens = rule_sets, screens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "field STRING", "value DOUBLE, ts LONG, event LONG")
        self.verdicts = handle.getMapState("verdicts", "scheme STRING", "verdict STRING, version LONG")
        self.until = handle.getValueState("until", "ms LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: tuple(v) for k, v in self.answers.iterator()} if self.answers.exists() else {}
        last = self.until.get()[0] if self.until.exists() else 0
        for batch in rows:
            for r in batch.itertuples():
                at = (int(r.ts.value // 1000), int(r.event_id))
                last = max(last, at[0] // 1000 + KEPT_MS)
                if r.field not in known or known[r.field][1:] <= at:
                    known[r.field] = (None if pd.isna(r.value) else float(r.value), *at)
                    self.answers.updateValue((r.field,), known[r.field])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last)
        self.until.update((last,))
        facts = {f: v[0] for f, v in effective(known, self.screens).items() if v[0] is not None}
        changed = []
        for rules in self.rule_sets:
            now = plain.verdict(rules, [facts])
            before, version = self.verdicts.getValue((rules.scheme_id,)) if self.verdicts.containsKey((rules.scheme_id,)) else (None, 0)
            if now != before:
                self.verdicts.updateValue((rules.scheme_id,), (now, version + 1))
                changed.append((key[0], rules.scheme_id, now, before, version + 1))
        if changed:
            yield pd.DataFrame(changed, columns=[c.split()[0] for c in VERDICT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.answers, self.verdicts, self.until):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def verdict_changes(answers: DataFrame, rule_sets: list[RuleSet], screens: dict[str, list[str]] | None = None, lateness: str = "1 day") -> DataFrame:
    """Changes of verdicts from an answer stream as for current_facts(): profile_id, scheme_id, verdict, before, version.

    A profile's answers are folded as there, by (ts, event_id) whatever their order of arrival; a decline leaves the
    fact unknown, so a later one takes an answer back. After each batch of its answers a profile is evaluated as an
    applicant without family, and a row comes for each rule set whose verdict is another than before (null at first).
    version numbers these by profile and rule set: the last version is the verdict that evaluate() gives for all
    answers. State is in maps of the state store, which has to be RocksDB's
    (spark.sql.streaming.stateStore.providerClass); a profile unseen for KEPT_MS is dropped by a timer.
    """
    grouped = answers.withWatermark("ts", lateness).groupBy("profile_id")
    return grouped.transformWithStateInPandas(_Verdicts(rule_sets, screens or {}), VERDICT, "Update", "EventTime")


def usage_windows(usage: DataFrame, budget_minute: float, budget_day: float, lateness: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Sliding sums of a usage stream (ts, tokens) with flags: 60 s every second, 24 h every hour."""

    def over(length: str, step: str, budget: float) -> DataFrame:
        sums = usage.withWatermark("ts", lateness).groupBy(F.window("ts", length, step)).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
        return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tokens", "calls", (F.col("tokens") > budget).alias("exceeded"))

    return over("60 seconds", "1 second", budget_minute), over("24 hours", "1 hour", budget_day)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a stream to its present end; write(batch, id) has to overwrite what an earlier try of the same id left."""
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
