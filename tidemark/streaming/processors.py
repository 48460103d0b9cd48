"""Stateful streams of a feed's lifecycle: health of sources, the morning fill from the day before, gates for what may run.

Each is a processor over typed state that survives restarts in the stream's checkpoint, can start from a table (state that
another run left) and be read back with read_state(). What a processor does with one round is a small pure function, so batch
replays and tests use the same rule. State per key has a bound: a source's last health, the best posts of a feed's sources of one
day, a gate's last attempt. They need the RocksDB state store: use_rocksdb() sets it for a session.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.health import PATHS, SUSPEND_H

DAY = 86_400


def use_rocksdb(spark: SparkSession) -> None:
    """Let new streams of the session keep their state in RocksDB, which processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a stopped stream as a table: key and value, or user_map_key and user_map_value of a map."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def _local(at: int) -> datetime:
    """Clock of a time in seconds; feeds' times are those of their own clock."""
    return datetime.fromtimestamp(at, timezone.utc)


def _rounds(rows: Iterator[pd.DataFrame], at: str = "at") -> Iterator[tuple[int, pd.DataFrame]]:
    """A key's rows of one batch by round, in order of time."""
    frames = [f for f in rows if len(f)]
    if frames:
        for when, part in pd.concat(frames, ignore_index=True).groupby(at, sort=True):
            yield int(when), part


# health of sources


@dataclass(frozen=True)
class Health:
    """A source's state; times in seconds, -1 unknown."""

    status: str
    last_update: int
    since: int
    n: int
    via: str


def next_health(was: Health | None, at: int, slow: bool, gone: bool, blocked: bool, n: int, via: str, last_update: int) -> Health:
    """A source's state after a round, by the rule of operators.health.source_health(). via: paths that gave posts, by commas."""
    paths = [p for p in PATHS if p in via.split(",")]
    status = "degraded" if slow else "missing" if gone else "ok"
    if status != "ok" and blocked and not [p for p in paths if p != PATHS[0]]:
        status = "blocked"
    last = last_update if last_update >= 0 else was.last_update if was else -1
    long_ago = at - last > SUSPEND_H * 3600 if last >= 0 else was is not None and was.status == "suspended"
    if status != "ok" and n == 0 and long_ago:
        status = "suspended"
    since = was.since if was and was.status == status and was.since >= 0 else at
    return Health(status, last, since, n, ",".join(paths))


_HEALTH = "status string, last_update long, since long, n long, via string"


class _HealthProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("health", _HEALTH)

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        for r in initial.itertuples():
            self.state.update((r.status, int(r.last_update), int(r.since), int(r.n), r.via))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = Health(*self.state.get()) if self.state.exists() else None
        out = []
        for at, part in _rounds(rows):
            r = part.iloc[0]
            was = next_health(was, at, bool(r.slow), bool(r.gone), bool(r.blocked), int(r.n), r.via or "", int(r.last_update))
            out.append((key[0], at, was.status, was.last_update, was.since, was.n, was.via))
        if was is not None:
            self.state.update((was.status, was.last_update, was.since, was.n, was.via))
        yield pd.DataFrame(out, columns=["source", "at", "status", "last_update", "since", "n", "via"])

    def close(self) -> None:
        pass


def health_stream(rounds: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(source, at, status, last_update, since, n, via): every source's state after each of its rounds.

    rounds is a stream of (source string, at long, slow boolean, gone boolean, blocked boolean, n long, via string, last_update long), times in
    seconds, a row a source and round (of several the first counts); a round comes in one batch. prior (source and the columns of state, -1
    for unknown times) is where the stream starts from when its checkpoint is new: sources that aren't in it start without state.
    """
    start = None if prior is None else prior.select("source", "status", "last_update", "since", "n", "via").groupBy("source")
    filled = rounds.na.fill({"slow": False, "gone": False, "blocked": False, "n": 0, "via": "", "last_update": -1})
    return filled.groupBy("source").transformWithStateInPandas(_HealthProcessor(), f"source string, at long, {_HEALTH}", "append", "none", start)


# the day before

#: Until this hour yesterday's list is saved, until that one it fills; sources and posts (CAP a source at most)
#: of today that end the filling of a round.
SAVE_UNTIL, FILL_UNTIL, DONE_SOURCES, DONE_POSTS, CAP = 2, 12, 19, 350, 25


@dataclass(frozen=True)
class Saved:
    """The posts saved of a day: (source, url_key, title, score), by source from the best down, CAP each."""

    day: str
    posts: tuple[tuple, ...] = ()


def best_of_day(rows: list[dict], day: str, cap: int = CAP) -> tuple[tuple, ...]:
    """Of a round the posts of the main path on that day, cap of a source, by score; ties by key."""
    mine = sorted((r for r in rows if not r["via"] and r["target_date"] == day), key=lambda r: (r["source"], -r["score"], r["url_key"]))
    had: Counter = Counter()
    out = []
    for r in mine:
        had[r["source"]] += 1
        if had[r["source"]] <= cap:
            out.append((r["source"], r["url_key"], r["title"], float(r["score"])))
    return tuple(out)


def day_before(was: Saved | None, at: int, complete: bool, rows: list[dict], done_sources: int = DONE_SOURCES, done_posts: int = DONE_POSTS) -> tuple[Saved | None, list[tuple]]:
    """What is saved after a round, and the posts that fill its sources' vacant places.

    Before SAVE_UNTIL yesterday's posts of the round are saved; a round that isn't complete replaces none of the same day. Until FILL_UNTIL
    they fill sources under CAP posts, with none that the round has; not while today's own posts reach done_sources and done_posts, which
    each round decides anew. From FILL_UNTIL on nothing is saved.
    """
    now = _local(at)
    today, yesterday = now.strftime("%Y-%m-%d"), (now - timedelta(days=1)).strftime("%Y-%m-%d")
    if now.hour < SAVE_UNTIL:
        found = best_of_day(rows, yesterday)
        held = not complete and was is not None and was.day == yesterday and bool(was.posts)
        return (was if not found or held else Saved(yesterday, found)), []
    if now.hour >= FILL_UNTIL:
        return None, []
    if was is None or was.day != yesterday:
        return was, []
    own = Counter(r["source"] for r in rows if not r["via"] and (r["target_date"] or today) == today)
    if len(own) >= done_sources and sum(min(n, CAP) for n in own.values()) >= done_posts:
        return was, []
    have, keys, extra = Counter(r["source"] for r in rows), {r["url_key"] for r in rows}, []
    for source, url_key, title, score in was.posts:
        if have[source] < CAP and url_key not in keys:
            keys.add(url_key)
            have[source] += 1
            extra.append((source, url_key, title, score))
    return was, extra


_POST = "url_key string, title string, score double"


class _DayBeforeProcessor(StatefulProcessor):
    def __init__(self, done_sources: int, done_posts: int) -> None:
        self.done = done_sources, done_posts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", "day string")
        self.posts = handle.getMapState("posts", "source string, place int", _POST)

    def _load(self) -> Saved | None:
        if not self.day.exists():
            return None
        return Saved(self.day.get()[0], tuple((k[0], *v) for k, v in sorted(self.posts.iterator(), key=lambda x: tuple(x[0]))))

    def _store(self, saved: Saved | None) -> None:
        self.posts.clear()
        if saved is None:
            self.day.clear()
            return
        self.day.update((saved.day,))
        place: Counter = Counter()
        for source, *post in saved.posts:
            self.posts.updateValue((source, place[source]), tuple(post))
            place[source] += 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = was = self._load()
        out = []
        for at, part in _rounds(rows):
            posts = [{k: None if isinstance(v, float) and v != v else v for k, v in r.items()} for r in part.to_dict("records")]
            was, extra = day_before(was, at, bool(part["complete"].all()), posts, *self.done)
            out += [(key[0], at, i, *x) for i, x in enumerate(extra)]
        if was != before:
            self._store(was)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if was is not None:  # saved posts go at noon of the day after theirs, though no round comes then
                noon = datetime.strptime(was.day, "%Y-%m-%d").replace(tzinfo=timezone.utc) + timedelta(days=1, hours=FILL_UNTIL)
                self.handle.registerTimer(int(noon.timestamp() * 1000))
        yield pd.DataFrame(out, columns=["feed", "at", "place", "source", "url_key", "title", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._store(None)
        yield pd.DataFrame([], columns=["feed", "at", "place", "source", "url_key", "title", "score"])

    def close(self) -> None:
        pass


def day_before_stream(posts: DataFrame, late: str = "0 seconds", done_sources: int = DONE_SOURCES, done_posts: int = DONE_POSTS) -> DataFrame:
    """(feed, at, place, source, url_key, title, score): for each round between two and noon the posts of the day before that fill it.

    posts is a stream of (feed string, ts timestamp, complete boolean, source string, target_date string, url_key string, title string, score
    double, via string); ts is the round's, on the feed's clock read as UTC, and a round comes in one batch. Rounds later than the watermark are dropped.
    State goes by a timer at noon of the clock of rounds, so a feed that falls silent leaves none.
    """
    timed = posts.withWatermark("ts", late).withColumn("at", F.unix_seconds("ts")).na.fill({"complete": True, "score": 0.0})
    return timed.groupBy("feed").transformWithStateInPandas(_DayBeforeProcessor(done_sources, done_posts), "feed string, at long, place int, source string, url_key string, title string, score double", "append", "EventTime")


# gates


@dataclass(frozen=True)
class Rule:
    """When a kind of run may start again; minutes, 0: no such wait. waits: after failures of a kind other than the usual."""

    interval: int = 0
    inclusive: bool = False
    retry: int = 0
    waits: tuple[tuple[str, int], ...] = ()
    same_day: bool = False
    per_day: int = 0
    give_up: int = 0


#: Summaries six hours apart, two hours after a failure and half an hour after a passing one; reports half an hour after a
#: failure of the same day; audio half an hour after a failure, three hours after a spent quota, six times a day, and no more on a day on
#: which publishing failed twice in a row; whole runs seven minutes apart.
RULES = {
    "summary": Rule(interval=360, inclusive=True, retry=120, waits=(("transient", 30),)),
    "report": Rule(retry=30, same_day=True),
    "audio": Rule(retry=30, waits=(("quota_day", 180),), per_day=6, give_up=2),
    "run": Rule(interval=7),
}


@dataclass(frozen=True)
class Gate:
    """What is known of a kind: times in seconds (-1: never), the last failure, attempts of a day, publishing failures in a row."""

    ok_at: int = -1
    failed_at: int = -1
    error: str = ""
    day: str = ""
    attempts: int = 0
    fails: int = 0


def opened(rule: Rule, gate: Gate, at: int) -> str:
    """'' if a run may start, else why not: interval, given_up, retry or quota."""
    today, day_of = _local(at).strftime("%Y-%m-%d"), lambda t: _local(t).strftime("%Y-%m-%d")
    if gate.ok_at >= 0 and rule.interval and (0 <= at - gate.ok_at < rule.interval * 60 or (rule.inclusive and at - gate.ok_at == rule.interval * 60)):
        return "interval"
    failed = gate.failed_at >= 0 and (not rule.same_day or day_of(gate.failed_at) == today)
    if rule.give_up and gate.error == "publish_failed" and gate.fails >= rule.give_up and failed and day_of(gate.failed_at) == today:
        return "given_up"
    wait = dict(rule.waits).get(gate.error, rule.retry) * 60
    if failed and (0 <= at - gate.failed_at < wait or (rule.inclusive and at - gate.failed_at == wait)):
        return "retry"
    if rule.per_day and gate.day == today and gate.attempts >= rule.per_day:
        return "quota"
    return ""


def after_attempt(gate: Gate, at: int, outcome: str) -> Gate:
    """A gate after a run that started; outcome is ok or the kind of failure."""
    today = _local(at).strftime("%Y-%m-%d")
    gate = replace(gate, day=today, attempts=gate.attempts + 1 if gate.day == today else 1)
    if outcome == "ok":
        return replace(gate, ok_at=at, failed_at=-1, error="", fails=0)
    return replace(gate, failed_at=at, error=outcome, fails=gate.fails + 1 if outcome == "publish_failed" else gate.fails)


def decided(gate: Gate, kind: str, at: int, outcome: str) -> tuple[Gate, str]:
    """A gate after a wish to run, and why it wasn't let through ('' if it was). Kinds without a rule always are."""
    why = opened(RULES.get(kind, Rule()), gate, at)
    return (gate if why else after_attempt(gate, at, outcome)), why


_GATE = "ok_at long, failed_at long, error string, day string, attempts int, fails int"
_DECISION = "feed string, kind string, at long, outcome string, allowed boolean, why string, attempts int"
#: Seconds without a wish after which a feed's gates are forgotten; no rule looks back as far.
FORGET = 2 * DAY


class _GateProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gates = handle.getMapState("gates", "kind string", _GATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known: dict[str, Gate] = {k[0]: Gate(*v) for k, v in self.gates.iterator()}
        out, last, before = [], 0, dict(known)
        for at, part in _rounds(rows):
            last = max(last, at)
            for r in part.sort_values(["kind", "outcome"], kind="stable").itertuples():
                known[r.kind], why = decided(known.get(r.kind, Gate()), r.kind, at, r.outcome)
                out.append((key[0], r.kind, at, r.outcome, not why, why, known[r.kind].attempts))
        for kind, gate in known.items():
            if gate != before.get(kind):
                self.gates.updateValue((kind,), (gate.ok_at, gate.failed_at, gate.error, gate.day, gate.attempts, gate.fails))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + FORGET) * 1000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _DECISION.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.gates.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in _DECISION.split(", ")])

    def close(self) -> None:
        pass


def gate_stream(wishes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(feed, kind, at, outcome, allowed, why, attempts) of a stream of wishes to run (feed string, kind string, ts timestamp, outcome string).

    outcome is what the run would give: ok, transient, quota_day, publish_failed or any other failure; it counts only if the gate lets the run
    through. attempts are those of the day. Null outcomes are failures "unknown". Wishes of one feed and time come in one batch.
    """
    timed = wishes.withWatermark("ts", late).withColumn("at", F.unix_seconds("ts")).na.fill({"outcome": "unknown", "kind": ""})
    return timed.groupBy("feed").transformWithStateInPandas(_GateProcessor(), _DECISION, "append", "EventTime")


def gate_replay(wishes: DataFrame) -> DataFrame:
    """The decisions of gate_stream() over a table of wishes: kinds don't meet, so each (feed, kind) is folded in order of time.

    Rows stream through a task sorted; what it holds of a fold is one gate.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, gate = None, Gate()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if (r.feed, r.kind) != key:
                    key, gate = (r.feed, r.kind), Gate()
                gate, why = decided(gate, r.kind, int(r.at), r.outcome)
                out.append((r.feed, r.kind, int(r.at), r.outcome, not why, why, gate.attempts))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DECISION.split(", ")])

    order = ["feed", "kind", "at", "outcome"]
    rows = wishes.select("feed", F.coalesce("kind", F.lit("")).alias("kind"), F.unix_seconds("ts").alias("at"), F.coalesce("outcome", F.lit("unknown")).alias("outcome"))
    return rows.repartition("feed", "kind").sortWithinPartitions(*order).mapInPandas(fold, _DECISION)
