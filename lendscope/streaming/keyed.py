"""Keyed state in Spark's state store, in event-time order.

``EventOrder`` is a ``StatefulProcessor`` over BUCKETS of keys: rows wait in list state until the
watermark has passed the newest of their batch, then an event-time timer hands over all that the
watermark has passed, in order of time (ties by ``order``).  So the result does not depend on how
rows arrive in files, batches or partitions.  What a key remembers between rows is a list of numbers;
those of a bucket's keys are one value in value state.  A restarted query goes on from its checkpoint; rows that come later than the watermark are
Spark's late rows (``jobs.run_to_end`` keeps them).

Three machines stand on it: alert rules (ST-04), sliding-log admission (ST-03 / ST-05) and
repeated-request suppression (ST-06).
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EPOCH = dt.datetime(1970, 1, 1)


def micros(ts: dt.datetime) -> int:
    return round((ts - EPOCH) / dt.timedelta(microseconds=1))


class Machine:
    """What one key does with its rows.

    ``decide(at, row)`` gets the event time in microseconds and the row's other fields and returns
    the fields it adds; ``saved()`` gives the numbers to remember, ``restore`` takes them back."""

    def restore(self, numbers: list[int]) -> None:
        raise NotImplementedError

    def saved(self) -> list[int]:
        raise NotImplementedError

    def decide(self, at: int, row: tuple) -> tuple:
        raise NotImplementedError


class RuleMachine(Machine):
    """ST-04: fires when the violations in a row reach ``need`` and the last firing is older than the cooldown."""

    def __init__(self, need: int, cooldown_s: int):
        self.need, self.cooldown, self.count, self.last = need, cooldown_s * 1_000_000, 0, None

    def restore(self, numbers):
        self.count, self.last = numbers[0], numbers[1] if len(numbers) > 1 else None

    def saved(self):
        return [self.count] + ([] if self.last is None else [self.last])

    def violation(self, at: int, violated: bool) -> bool:
        self.count = self.count + 1 if violated else 0
        fired = violated and self.count >= self.need and (self.last is None or at - self.last > self.cooldown)
        if fired:
            self.count, self.last = 0, at
        return fired

    def decide(self, at, row):
        fired = self.violation(at, bool(row[-1]))
        return self.count, fired


class SlidingLog(Machine):
    """ST-03: at most ``limit`` recorded requests in the last ``window`` seconds; denied requests are not recorded."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window, self.log = limit, window_s * 1_000_000, deque()

    def restore(self, numbers):
        self.log = deque(numbers)

    def saved(self):
        return list(self.log)

    def decide(self, at, row):
        while self.log and self.log[0] < at - self.window:     # keep t >= now - W
            self.log.popleft()
        ok = len(self.log) < self.limit
        if ok:
            self.log.append(at)
        # the oldest kept request + W
        return ok, max(self.limit - len(self.log), 0), EPOCH + dt.timedelta(
            microseconds=(self.log[0] if self.log else at) + self.window)


class LastAccepted(SlidingLog):
    """ST-06: a repeat younger than the TTL of the last accepted request is suppressed."""

    def __init__(self, ttl_s: int):
        super().__init__(1, ttl_s)

    def decide(self, at, row):
        ok = not self.log or at - self.log[-1] >= self.window    # a repeat counts while its age < TTL
        if ok:
            self.log = deque([at])
        return ok, 0, EPOCH + dt.timedelta(microseconds=self.log[-1] + self.window)


class EventOrder(StatefulProcessor):
    """Hands the rows of a bucket of keys to their machines once the watermark has passed them.

    Every call of the state store is a trip between Python and the JVM, so there are a few for each bucket
    and batch and none for a key or a row: an Arrow batch waits as one value, and so does what the keys of
    a bucket remember.

    ``keys`` of a row come first, then its time in microseconds (``at``) and the other fields; ``whole``
    are the places of whole numbers, which come as text, since a null beside them would round them.
    ``make(key, row)`` builds the machine of a key from its first row's fields; the field at ``order``
    breaks ties.  ``forget_s``: a key without rows for so long loses its state (None: it stays)."""

    def __init__(self, columns: list[str], keys: int, whole: list[int], make: Callable[[tuple, tuple], Machine],
                 out: list[str], order: int, forget_s: int | None):
        self.columns, self.keys, self.whole, self.make, self.out, self.order, self.forget = (
            columns, keys, whole, make, out, order, forget_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getValueState("memory", "machines binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:                                  # Arrow batches: a busy bucket is never gathered here
            values = [pdf[c].tolist() for c in self.columns]
            for i in self.whole:
                values[i] = [None if v is None else int(v) for v in values[i]]
            part = [(r[:self.keys], r[self.keys:]) for r in zip(*values)]
            self.waiting.appendValue((pickle.dumps(part),))
            last = max(values[self.keys])
            newest = last if newest is None else max(newest, last)
        if newest is not None:
            self.handle.registerTimer(self._due(newest))  # one timer a bucket and batch
        return iter(())

    @staticmethod
    def _due(at: int) -> int:
        return -(-at // 1000)                             # milliseconds, rounded up

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs()
        held = [kr for v in self.waiting.get() for kr in pickle.loads(v[0])] if self.waiting.exists() else []
        ready = sorted((kr for kr in held if self._due(kr[1][0]) <= limit),
                       key=lambda kr: (kr[1][0], kr[1][self.order] is not None, kr[1][self.order]))
        memory = pickle.loads(self.memory.get()[0]) if self.memory.exists() else {}
        known, out, machines = len(memory), [], {}
        for k, r in ready:
            machine = machines.get(k)
            if machine is None:
                machine = machines[k] = self.make(k, r)
                if k in memory:
                    machine.restore(list(memory[k][0]))
            out.append((*k, *r, *machine.decide(r[0], r)))
            memory[k] = None, self._due(r[0]) + (self.forget or 0) * 1000 + 1
        if machines:
            until = max(memory[k][1] for k in machines)
            memory.update((k, (m.saved(), memory[k][1])) for k, m in machines.items())
            later = [kr for kr in held if self._due(kr[1][0]) > limit]
            self.waiting.put([(pickle.dumps(later),)]) if later else self.waiting.clear()
            if self.forget is not None and until > limit:
                self.handle.registerTimer(until)
        if self.forget is not None:                       # later rows are younger than what these remember
            memory = {k: m for k, m in memory.items() if m[1] > limit}
        if not memory:
            self.memory.clear()
        elif machines or len(memory) != known:
            self.memory.update((pickle.dumps(memory),))
        if out:
            pdf = pd.DataFrame(out, columns=self.out)
            at = self.out[self.keys]
            pdf[at] = pd.to_datetime(pdf[at], unit="us")
            yield pdf

    def close(self) -> None:
        pass


BUCKETS = 4096                    # of keys; fixed for the life of a checkpoint
WHOLE = ("tinyint", "smallint", "int", "bigint")


def in_event_order(stream: DataFrame, keys: list[str], at: str, fields: dict[str, str], make, adds: str, order: str,
                   forget_s: int | None = None) -> DataFrame:
    """``stream`` (with a watermark on ``at``) through one ``Machine`` for each key.

    Returns the keys, ``at``, the ``fields`` (name -> type) and what the machine ``adds`` (DDL).  Rows
    without a time are left out."""
    kinds = dict(stream.dtypes)
    columns = [*keys, at, *fields]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{at} timestamp", *(f"{c} {t}" for c, t in fields.items()), adds])
    out = [c.split()[0] for c in schema.split(", ")]
    whole = [i for i, c in enumerate(columns) if c != at and kinds[c] in WHOLE]
    sent = [f"sent_{c}" if c == at or i in whole else c for i, c in enumerate(columns)]
    machine = EventOrder(sent, len(keys), whole, make, out, [at, *fields].index(order), forget_s)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket_of_keys")
    ready = [F.unix_micros(c).alias(n) if c == at else F.col(c).cast("string").alias(n) if n != c else F.col(c)
             for n, c in zip(sent, columns)]
    return stream.where(F.col(at).isNotNull()).select(bucket, at, *ready).groupBy(
        "bucket_of_keys").transformWithStateInPandas(
        statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def in_event_order_of_table(table: DataFrame, keys: list[str], at: str, fields: dict[str, str], make, adds: str,
                            order: str) -> DataFrame:
    """The same on a table.  Spark deals rows by key and sorts them by time, and a key streams through its
    machine without being gathered."""
    kinds = dict(table.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{at} {kinds[at]}", *(f"{c} {t}" for c, t in fields.items()), adds])
    names, n = [c.split()[0] for c in schema.split(", ")], len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for pdf in batches:
            out = []
            for r in pdf.astype(object).itertuples(index=False, name=None):
                if r[:n] != key:
                    key, machine = r[:n], make(r[:n], r[n:])
                out.append((*r, *machine.decide(micros(r[n]), r[n:])))
            yield pd.DataFrame(out, columns=names)

    return (table.where(F.col(at).isNotNull()).select(*keys, at, *fields).repartition(*keys).sortWithinPartitions(*keys, at, order).mapInPandas(run, schema))


def rules_on_stream(matched: DataFrame, at: str = "ts") -> DataFrame:
    """ST-04: matched ticks (see ``operators.alerts.match_rules``) through the machine of each rule.

    ``at``: the tick's event time, with a watermark.  Returns name, ``at``, metric_name, value, threshold,
    severity, alert_type, failures, fired."""
    def make(key, row):
        return RuleMachine(int(row[6]), int(row[7]))

    fields = {"metric_name": "string", "value": "double", "threshold": "double", "severity": "string", "alert_type": "string",
              "consecutive_failures": "int", "cooldown_period": "int", "violated": "boolean"}
    return in_event_order(matched, ["name"], at, fields, make, "failures int, fired boolean", "metric_name").drop(
        "consecutive_failures", "cooldown_period", "violated")


