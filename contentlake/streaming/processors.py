"""Keyed state machines on ``transformWithStateInPandas``.

Strikes, peer lists and refresh sums merge rows in any order, and their rows are reduced inside each
Arrow batch before the shuffle, so a hot key sends a few rows per batch. Averages, retries and
buckets follow the time order of a key's rows within a micro-batch, and hold two or three numbers of each meanwhile.

Every key's state ends by an event-time timer, except that of buckets, whose number and size are fixed.
A stream needs the RocksDB state store (``streams.ROCKSDB``), as all ``transformWithState`` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contentlake.settings import DEFAULTS


def _move_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """Let the key's only timer end at ``at_ms``."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(at_ms)


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple[int, ...]]:
    """A key's rows of a micro-batch in the order of ``columns``: only these numbers are held, eight bytes each."""
    held = np.concatenate([np.stack([chunk[c].to_numpy(dtype="int64") for c in columns]) for chunk in rows], axis=1)
    for k in np.lexsort(held[::-1]):
        yield tuple(held[:, k].tolist())


def _reduced(df: DataFrame, reduce) -> DataFrame:
    """``df`` with ``reduce`` applied to every Arrow batch ahead of the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield reduce(batch)

    return df.mapInPandas(run, df.schema)


# --- strikes ----------------------------------------------------------------------------------


def first_attempts(batch: pd.DataFrame) -> pd.DataFrame:
    """Per key the first two failures and the first fetched or filtered row of a batch."""
    ordered = batch.sort_values(["at", "event_id"])
    failed = ordered[ordered["outcome"] == "failed"].groupby("info_hash").head(2)
    done = ordered[ordered["outcome"].isin(["fetched", "filtered"])].groupby("info_hash").head(1)
    return pd.concat([failed, done])


class StrikeProcessor(StatefulProcessor):
    """Keeps the two earliest failures and the earliest fetched or filtered row of a key, and emits
    the key's standing whenever it changes. Order of arrival does not matter. A key is dropped
    ``forget`` seconds of event time after its last counted row; what must stay blocked for longer
    belongs in the table of seen keys (``streams.admit_new``)."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "f1 bigint, i1 bigint, f2 bigint, i2 bigint, done bigint, done_id bigint, outcome string"
        self.state = handle.getValueState("strikes", schema)

    @staticmethod
    def standing(f1, f2, done, outcome) -> tuple:
        first = f1 is not None and (done is None or f1 < done)
        second = f2 is not None and (done is None or f2 < done)
        return first, second, "blocked" if second else outcome

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (None,) * 7
        failures = [(a, i) for a, i in (known[0:2], known[2:4]) if a is not None]
        done, outcome = (tuple(known[4:6]), known[6]) if known[4] is not None else (None, None)
        pair = (*failures, None, None)[:2]
        before = self.standing(*pair, done, outcome)
        for chunk in rows:
            for at, event_id, kind in zip(chunk["at"], chunk["event_id"], chunk["outcome"]):
                place = (int(at), int(event_id))
                if kind == "failed":
                    failures = sorted({*failures, place})[:2]
                elif done is None or place < done:
                    done, outcome = place, kind
        f1, f2 = (*failures, None, None)[:2]
        self.state.update((*(f1 or (None, None)), *(f2 or (None, None)), *(done or (None, None)), outcome))
        latest = max(place[0] for place in (f1, f2, done) if place is not None)
        _move_timer(self.handle, latest // 1000 + self.forget * 1000)
        after = self.standing(f1, f2, done, outcome)
        if after != before or not any(known):
            yield pd.DataFrame([(key[0], *after)], columns=["info_hash", "first_strike", "second_strike", "seen_as"])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def strike_stream(attempts: DataFrame, forget: int = DEFAULTS.forget_seconds, delay: str = "1 hour") -> DataFrame:
    """attempts(info_hash, at, event_id, outcome), ``at`` in microseconds -> standing updates."""
    rows = _reduced(attempts.select("info_hash", "at", "event_id", "outcome"), first_attempts)
    rows = rows.withColumn("_ts", F.timestamp_micros("at")).withWatermark("_ts", delay)
    return rows.groupBy("info_hash").transformWithStateInPandas(
        statefulProcessor=StrikeProcessor(forget),
        outputStructType="info_hash string, first_strike boolean, second_strike boolean, seen_as string",
        outputMode="Update",
        timeMode="EventTime",
    )


# --- peer lists -------------------------------------------------------------------------------


def last_sightings(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.groupby(["key", "ip", "port"], as_index=False)["at"].max()[["key", "ip", "port", "at"]]


class PeerListProcessor(StatefulProcessor):
    """The newest ``per_key`` addresses of a key, each with its last sighting, none older than
    ``ttl`` seconds before the newest. Emits the whole (bounded) list after every change; a key is
    forgotten ``ttl`` seconds of event time after its newest sighting."""

    def __init__(self, per_key: int, ttl: int):
        self.per_key, self.ttl = per_key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.peers = handle.getListState("peers", "ip bigint, port bigint, at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {(ip, port): at for ip, port, at in self.peers.get()}
        for chunk in rows:
            for ip, port, at in zip(chunk["ip"], chunk["port"], chunk["at"]):
                address = (int(ip), int(port))
                seen[address] = max(int(at), seen.get(address, int(at)))
            ranked = sorted(seen.items(), key=lambda peer: (-peer[1], peer[0]))
            oldest = ranked[0][1] - self.ttl
            seen = {a: at for a, at in ranked[: self.per_key] if at >= oldest}
        kept = [(ip, port, at) for (ip, port), at in seen.items()]
        self.peers.put(kept)
        _move_timer(self.handle, (kept[0][2] + self.ttl + 1) * 1000)
        listed = [(key[0], ip, port, at, rank) for rank, (ip, port, at) in enumerate(kept, start=1)]
        yield pd.DataFrame(listed, columns=["key", "ip", "port", "at", "rank"])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.peers.clear()
        return iter(())

    def close(self) -> None:
        pass


def peer_list_stream(
    observations: DataFrame, per_key: int = DEFAULTS.peers_per_key, ttl: int = DEFAULTS.forget_seconds, delay: str = "1 hour"
) -> DataFrame:
    """observations(key, ip, port, at) -> the list of a key after each micro-batch that touched it."""
    rows = _reduced(observations.select("key", "ip", "port", "at"), last_sightings)
    rows = rows.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=PeerListProcessor(per_key, ttl),
        outputStructType="key bigint, ip bigint, port bigint, at bigint, rank int",
        outputMode="Update",
        timeMode="EventTime",
    )


# --- retries ----------------------------------------------------------------------------------


class RetryProcessor(StatefulProcessor):
    """Decides after every finished search of a key: complete (enough peers, or attempts used up with
    some), failed (attempts used up without any) or retry (due after the delay in whole seconds).
    An entry older than ``max_age`` seconds of event time is forgotten."""

    def __init__(self, max_attempts: int, min_peers: int, delay_ms: int, max_age: int):
        self.max_attempts, self.min_peers, self.delay_ms, self.max_age = max_attempts, min_peers, delay_ms, max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "retries int, created_at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        retries, created = self.entry.get() if self.entry.exists() else (0, None)
        out = []
        for at, _, peers in _in_order(rows, "at", "event_id", "peers"):
            if created is None or at - created > self.max_age:
                retries, created = 0, at
            if peers >= self.min_peers or retries >= self.max_attempts:
                out.append((key[0], at, retries + 1, peers, "complete" if peers > 0 else "failed", None))
                created = None
            else:
                out.append((key[0], at, retries + 1, peers, "retry", at + self.delay_ms // 1000))
                retries += 1
        if created is None:
            self.entry.clear()
        else:
            self.entry.update((retries, created))
            self.handle.registerTimer((created + self.max_age + 1) * 1000)
        yield pd.DataFrame(out, columns=["key", "at", "attempts", "peers", "decision", "due_at"]).astype({"due_at": "Int64"})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and (self.entry.get()[1] + self.max_age + 1) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def retry_stream(
    results: DataFrame, max_attempts: int = DEFAULTS.max_attempts, min_peers: int = DEFAULTS.ready_peers,
    delay_ms: int = 300, max_age: int = 60, delay: str = "1 minute",
) -> DataFrame:
    """results(key, at, event_id, peers) -> a decision per finished search."""
    timed = results.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RetryProcessor(max_attempts, min_peers, delay_ms, max_age),
        outputStructType="key bigint, at bigint, attempts int, peers bigint, decision string, due_at bigint",
        outputMode="Update",
        timeMode="EventTime",
    )


# --- buckets ----------------------------------------------------------------------------------


class BucketProcessor(StatefulProcessor):
    """A bounded bucket of nodes: failures count up and remove at the limit, a sighting refreshes, a
    newcomer to a full bucket takes the slot of a failed node, else of the least recently seen one
    if that is old enough, else is rejected. The state needs no timer: one list of at most ``cap``
    nodes for each bucket of the key space."""

    def __init__(self, cap: int, max_failures: int, min_age: int):
        self.cap, self.max_failures, self.min_age = cap, max_failures, min_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.nodes = handle.getListState("nodes", "node_id string, last_seen bigint, fail_count int")

    def admit(self, held: dict, node: str, at: int) -> None:
        if node in held:
            held[node] = (at, 0)
            return
        if len(held) >= self.cap:
            failed = [n for n, (_, fails) in held.items() if fails >= self.max_failures]
            oldest = min(held, key=lambda n: (held[n][0], n))
            if failed:
                del held[min(failed)]
            elif at - held[oldest][0] >= self.min_age:
                del held[oldest]
            else:
                return
        held[node] = (at, 0)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {node: (at, fails) for node, at, fails in self.nodes.get()}
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            if row.kind == "seen":
                self.admit(held, row.node_id, int(row.at))
            elif row.kind == "failed" and row.node_id in held:
                at, fails = held[row.node_id]
                held[row.node_id] = (at, fails + 1)
                if fails + 1 >= self.max_failures:
                    del held[row.node_id]
        kept = [(node, at, fails) for node, (at, fails) in held.items()]
        self.nodes.put(kept) if kept else self.nodes.clear()
        listed = [(key[0], *node) for node in kept]
        yield pd.DataFrame(listed, columns=["bucket", "node_id", "last_seen", "fail_count"])

    def close(self) -> None:
        pass


def bucket_stream(
    events: DataFrame, cap: int = DEFAULTS.bucket_capacity, max_failures: int = DEFAULTS.max_failures,
    min_age: int = DEFAULTS.min_evict_age,
) -> DataFrame:
    """events(bucket, node_id, at, event_id, kind) -> the bucket's nodes after each micro-batch."""
    return events.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(cap, max_failures, min_age),
        outputStructType="bucket int, node_id string, last_seen bigint, fail_count int",
        outputMode="Update",
        timeMode="None",
    )


# --- smoothed rates ---------------------------------------------------------------------------


class EmaProcessor(StatefulProcessor):
    """The rate between neighbouring readings of a key's counter, its running average, and a shut-down
    once a low reading is still low one smoothing step later, at the first reading after the grace
    period. A key is forgotten ``forget`` seconds of event time after its last reading."""

    def __init__(self, alpha: float, minimum: float, min_age: int, grace: int, forget: int):
        self.alpha, self.minimum, self.min_age, self.grace, self.forget = alpha, minimum, min_age, grace, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ema double, born bigint, n bigint, at bigint")
        self.waiting = handle.getListState("waiting", "at bigint, ema double, n0 bigint, at0 bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ema, born, n0, at0 = self.last.get() if self.last.exists() else (None,) * 4
        waiting = list(self.waiting.get())
        out = []
        for at, n in _in_order(rows, "at", "n"):
            if born is None:
                born, n0, at0 = at, n, at
                continue
            rate = (n - n0) / (at - at0) if at > at0 else 0.0
            ema = rate if ema is None else self.alpha * rate + (1.0 - self.alpha) * ema
            low = ema < self.minimum and at - born >= self.min_age
            out.append((key[0], at, ema, low, None))
            # a reading can end the wait of earlier low readings, and its own without a grace period
            if low:
                waiting.append((at, ema, n0, at0))
            ready = [w for w in waiting if at >= w[0] + self.grace]
            waiting = [w for w in waiting if at < w[0] + self.grace]
            for low_at, low_ema, low_n, low_from in ready:
                again = self.alpha * (n - low_n) / (at - low_from) + (1.0 - self.alpha) * low_ema
                if again < self.minimum:
                    out.append((key[0], low_at, again, True, at))
            n0, at0 = n, at
        self.last.update((ema, born, n0, at0))
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        _move_timer(self.handle, (at0 + self.forget) * 1000)
        yield pd.DataFrame(out, columns=["key", "at", "ema", "low", "shut_down_at"]).astype({"shut_down_at": "Int64"})

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.waiting.clear()
        return iter(())

    def close(self) -> None:
        pass


def ema_stream(
    counters: DataFrame, minimum: float, min_age: int, grace: int, alpha: float = DEFAULTS.ema_alpha,
    forget: int = DEFAULTS.forget_seconds, delay: str = "1 hour",
) -> DataFrame:
    """counters(key, at, n) -> one row per reading with a rate (``shut_down_at`` NULL) and one per
    shut-down, at the low reading that caused it."""
    timed = counters.select("key", "at", "n", F.timestamp_seconds("at").alias("_ts")).withWatermark("_ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=EmaProcessor(alpha, minimum, min_age, grace, forget),
        outputStructType="key bigint, at bigint, ema double, low boolean, shut_down_at bigint",
        outputMode="Update",
        timeMode="EventTime",
    )


# --- refresh requests -------------------------------------------------------------------------


def summed_answers(batch: pd.DataFrame) -> pd.DataFrame:
    """Answers of a batch summed per key and second; requests as they are."""
    asked = batch[batch["request_id"].notna()]
    answers = batch[batch["request_id"].isna()]
    sums = answers.groupby(["info_hash", "at"], as_index=False).agg({"ts": "max", "peers": "sum"})
    return pd.concat([asked, sums])[list(batch.columns)].astype({c: "Int64" for c in ("request_id", "done_at", "retry_done_at")})


class RefreshProcessor(StatefulProcessor):
    """Sums the peers reported within a request's wait, and within its second wait when the first
    ended without peers and without a timeout. A request's two sums grow as answers come in and are
    reported whenever they change; a last report (``closed``) comes once the watermark has passed both
    waits. Answers are kept by second for requests that arrive after them, until the watermark.

    A key has one timer, at the first of its ends, and lists that are read and written whole: calls to the state follow
    the number of keys in a batch, not that of requests, answers or ends."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "request_id bigint, at bigint, done bigint, done2 bigint, first bigint, second bigint"
        self.requests = handle.getListState("requests", schema)
        self.answers = handle.getListState("answers", "at bigint, peers bigint")  # sums of a second may stand in several parts
        self.due = handle.getValueState("due", "at bigint")

    def waits(self, at: int, done, done2) -> tuple[int, bool, int, bool]:
        end = min(done, at + self.seconds) if done is not None else at + self.seconds
        end2 = min(done2, end + self.seconds) if done2 is not None else end + self.seconds
        late = done is None or done > at + self.seconds
        return end, late, end2, done2 is None or done2 > end + self.seconds

    def over_at(self, request: tuple) -> int:
        """The second at which both waits of a request have passed."""
        return self.waits(*request[1:4])[2] + 1

    def grown(self, request: tuple, sums: dict[int, int]) -> tuple:
        request_id, at, done, done2, first, second = request
        end, _, end2, _ = self.waits(at, done, done2)
        if len(sums) <= end2 - at:
            first += sum(n for t, n in sums.items() if at <= t <= end)
            second += sum(n for t, n in sums.items() if end < t <= end2)
        else:
            first += sum(sums.get(t, 0) for t in range(at, end + 1))
            second += sum(sums.get(t, 0) for t in range(end + 1, end2 + 1))
        return request_id, at, done, done2, first, second

    def report(self, key: Any, requests: list[tuple], closed: bool) -> pd.DataFrame:
        out = []
        for request_id, at, done, done2, first, second in requests:
            _, late, _, late2 = self.waits(at, done, done2)
            retried = first == 0 and not late
            out.append((key[0], request_id, second if retried else first, late2 if retried else late, retried, closed))
        columns = ["info_hash", "request_id", "total_peers", "timed_out", "retry_attempted", "closed"]
        return pd.DataFrame(out, columns=columns)

    def known_answers(self) -> dict[int, int]:
        sums: dict[int, int] = {}
        for at, peers in self.answers.get():
            sums[at] = sums.get(at, 0) + peers
        return sums

    def wake(self, at: int) -> None:
        """Let the timer end at ``at`` unless it ends before."""
        if self.due.exists():
            due = self.due.get()[0]
            if due <= at:
                return
            self.handle.deleteTimer(due * 1000)
        self.due.update((at,))
        self.handle.registerTimer(at * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked, sums = [], {}
        for chunk in rows:
            for row in chunk.itertuples():
                at = int(row.at)
                if pd.isna(row.request_id):
                    sums[at] = sums.get(at, 0) + int(row.peers)
                else:
                    done, done2 = (None if pd.isna(d) else int(d) for d in (row.done_at, row.retry_done_at))
                    asked.append((int(row.request_id), at, done, done2, 0, 0))
        before = [tuple(request) for request in self.requests.get()]
        after = [self.grown(request, sums) for request in before] if sums else before
        changed = [new for old, new in zip(before, after) if new != old]
        if sums:
            self.answers.appendList(list(sums.items()))
        if asked:
            known = self.known_answers()
            new = [self.grown(request, known) for request in asked]
            after, changed = after + new, changed + new
        if changed:
            self.requests.put(after)
        if asked or sums:
            self.wake(min([self.over_at(request) for request in asked] + ([max(sums) + 1] if sums else [])))
        if changed:
            yield self.report(key, changed, False)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Close all that the watermark has passed, and sleep until the next end."""
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.due.clear()
        held = self.known_answers()
        kept = {at: peers for at, peers in held.items() if (at + 1) * 1000 > passed}
        if len(kept) < len(held):
            self.answers.put(list(kept.items())) if kept else self.answers.clear()
        done, waiting = [], []
        for request in self.requests.get():
            (done if self.over_at(tuple(request)) * 1000 <= passed else waiting).append(tuple(request))
        if done:
            self.requests.put(waiting) if waiting else self.requests.clear()
        ends = [self.over_at(request) for request in waiting] + ([max(kept) + 1] if kept else [])
        if ends:
            self.wake(min(ends))
        if done:
            yield self.report(key, done, True)

    def close(self) -> None:
        pass


def refresh_stream(rows: DataFrame, delay: str, seconds: int = DEFAULTS.request_seconds) -> DataFrame:
    """rows(info_hash, ts, at, request_id, done_at, retry_done_at, peers) -> reports of requests, the last of each ``closed``.

    A row with a request_id opens a request at second ``at``; any other reports ``peers``.
    """
    columns = ["info_hash", "ts", "at", "request_id", "done_at", "retry_done_at", "peers"]
    merged = _reduced(rows.select(*columns), summed_answers).withWatermark("ts", delay)
    return merged.groupBy("info_hash").transformWithStateInPandas(
        statefulProcessor=RefreshProcessor(seconds),
        outputStructType="info_hash string, request_id bigint, total_peers bigint, timed_out boolean, retry_attempted boolean, closed boolean",
        outputMode="Update",
        timeMode="EventTime",
    )


# --- rolling hours ----------------------------------------------------------------------------


def minute_sums(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.groupby(["key", "minute"], as_index=False)["n"].sum()[["key", "minute", "n"]]


class HourProcessor(StatefulProcessor):
    """Counts of a key per minute, and from them the count of the hour that ends with each minute. Every hour that a batch changes
    is reported, also one that is still open; the last report of an hour is the whole one. A minute is kept until
    ``keep`` seconds of event time after the last hour that it belongs to."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute bigint", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[int, int] = {}
        for chunk in rows:
            for minute, n in zip(chunk["minute"].tolist(), chunk["n"].tolist()):
                changed[minute] = changed.get(minute, 0) + n
        for minute, n in changed.items():
            held = self.counts.getValue((minute,))[0] if self.counts.containsKey((minute,)) else 0
            self.counts.updateValue((minute,), (held + n,))
        counts = {minute[0]: n[0] for minute, n in self.counts.iterator()}
        ends = sorted({minute + later for minute in changed for later in range(60)})
        out, total, last = [], 0, None
        for end in ends:  # the difference between neighbouring hours, a fresh sum behind a gap
            if last == end - 1:
                total += counts.get(end, 0) - counts.get(end - 60, 0)
            else:
                total = sum(counts.get(minute, 0) for minute in range(end - 59, end + 1))
            out.append((key[0], end, total))
            last = end
        _move_timer(self.handle, (min(counts) + 60) * 60_000 + self.keep * 1000)
        yield pd.DataFrame(out, columns=["key", "minute", "last_hour"])

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = [minute[0] for minute, _ in self.counts.iterator()]
        left = [minute for minute in held if (minute + 60) * 60_000 + self.keep * 1000 > now]
        for minute in held:
            if minute not in left:
                self.counts.removeKey((minute,))
        if left:
            self.handle.registerTimer((min(left) + 60) * 60_000 + self.keep * 1000)
        return iter(())

    def close(self) -> None:
        pass


def hour_stream(rows: DataFrame, delay: str, keep: int = 600) -> DataFrame:
    """rows(key, ts) -> (key, minute, last_hour) whenever the count of the hour that ends with ``minute`` changes.

    Rows are counted per key and minute inside each Arrow batch, so a hot key sends as many rows as a batch has minutes; a
    key's state is as long as ``delay`` and an hour.
    """
    minute = F.floor(F.unix_timestamp("ts") / 60)
    counted = _reduced(rows.select("key", minute.alias("minute"), F.lit(1).cast("bigint").alias("n")), minute_sums)
    timed = counted.withColumn("_ts", F.timestamp_seconds(F.col("minute") * 60)).withWatermark("_ts", delay)
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=HourProcessor(keep),
        outputStructType="key string, minute bigint, last_hour bigint",
        outputMode="Update",
        timeMode="EventTime",
    )
