"""Keyed state that expires: the last state of each job, and the running profile of each user.

Both are ``transformWithState`` operators with value and map state and event-time timers.  Rows older than the watermark
of their batch are left out.  Rows of a key count in event-time order within a batch; a row that comes after an
idle time of ``ttl`` starts a new episode whether or not the timer has fired before, so the result does not depend on
how the stream is cut into batches as long as rows are late by less than the watermark's delay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State with maps and timers needs the store that comes with Spark for it.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_JOB = "since long, ts long, seq long, status string, progress long, stage string, max_progress long, updates long, stale boolean"
_JOB_OUT = "job_id long, event string, since long, ts long, status string, progress long, stage string, max_progress long, updates long, artifacts array<string>"
_PROFILE = "since long, ts long, total long, errors long, components long"
_PROFILE_OUT = "user_id long, event string, since long, ts long, total long, errors long, components long, kinds array<string>, experience_level string"


def millis(text: str) -> int:
    """A duration such as ``24 hours`` in milliseconds."""
    return int(pd.Timedelta(text).total_seconds() * 1000)


def ordered(rows: Iterator[pd.DataFrame], watermark: int, *columns: str) -> list[tuple]:
    """The rows of a key in one batch from the watermark on, in the order of the first columns."""
    every = (t for f in rows for t in f[list(columns)].itertuples(index=False, name=None))
    return sorted((t for t in every if t[0] // 1000 >= watermark), key=lambda t: t[:2])


class Expiring(StatefulProcessor):
    """Common part: an episode of a key ends when no row came for ``ttl`` milliseconds of event time."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def due(self, ts: int) -> int:
        """When, in milliseconds, an episode whose last row was at ``ts`` microseconds ends."""
        return ts // 1000 + self.ttl

    def over(self, last: int, ts: int) -> bool:
        return ts // 1000 >= self.due(last)


class JobStates(Expiring):
    """Last status, stage and progress of a job with the artifacts merged by name; late and early rows in any order.

    A job that is not done and has not moved for ``age`` is reported as stale, once per silence.
    """

    def __init__(self, ttl: int, age: int, done: tuple[str, ...]):
        super().__init__(ttl)
        self.age, self.done = age, done

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", _JOB)
        self.artifacts = handle.getMapState("artifacts", "name string", "value string, ts long, seq long")

    def row(self, key: tuple, event: str, job: tuple, artifacts: dict[str, tuple]) -> tuple:
        since, ts, _, status, progress, stage, most, updates, _ = job
        return (key[0], event, since, ts, status, progress, stage, most, updates, [f"{name}={artifacts[name][0]}" for name in sorted(artifacts)])

    def kept(self) -> dict[str, tuple]:
        return {name[0]: tuple(value) for name, value in self.artifacts.iterator()}

    def timers(self, job: tuple) -> list[int]:
        ts, status, stale = job[1], job[3], job[8]
        waits = [self.due(ts)]
        if self.age < self.ttl and status not in self.done and not stale:
            waits.append(ts // 1000 + self.age)
        return waits

    def quiet(self, job: tuple, ts: int) -> bool:
        """Whether the job was stale before a row at ``ts`` and has not been reported."""
        return self.age < self.ttl and job[3] not in self.done and not job[8] and ts // 1000 >= job[1] // 1000 + self.age

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job = tuple(self.job.get()) if self.job.exists() else None
        artifacts = self.kept() if job else {}
        for wait in self.timers(job) if job else []:
            self.handle.deleteTimer(wait)
        out, changed = [], set()
        for ts, seq, status, progress, stage, name, value in ordered(rows, timerValues.getCurrentWatermarkInMs(), "us", "seq", "status", "progress", "stage", "artifact", "artifact_value"):
            if job and self.quiet(job, ts):
                out.append(self.row(key, "stale", job, artifacts))
                job = (*job[:8], True)
            if job and self.over(job[1], ts):
                out.append(self.row(key, "closed", job, artifacts))
                job, artifacts, changed = None, {}, set()
                self.artifacts.clear()
            newer = job is None or (ts, seq) >= (job[1], job[2])
            since, most, updates = (min(job[0], ts), max(job[6], progress), job[7] + 1) if job else (ts, progress, 1)
            if newer:
                job = (since, ts, seq, status, progress, stage, most, updates, False)
            else:
                job = (since, *job[1:6], most, updates, job[8])
            if name is not None and (name not in artifacts or (ts, seq) >= artifacts[name][1:]):
                artifacts[name] = (value, ts, seq)
                changed.add(name)
        if job is None:
            return
        self.job.update(job)
        for name in changed:
            self.artifacts.updateValue((name,), artifacts[name])
        for wait in self.timers(job):
            self.handle.registerTimer(wait)
        out.append(self.row(key, "open", job, artifacts))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in _JOB_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.job.exists():
            return
        job, now = tuple(self.job.get()), expiredTimerInfo.getExpiryTimeInMs()
        artifacts = self.kept()
        if now >= self.due(job[1]):
            out = self.row(key, "closed", job, artifacts)
            self.job.clear()
            self.artifacts.clear()
        elif self.quiet(job, now * 1000 + 999):
            out = self.row(key, "stale", job, artifacts)
            self.job.update((*job[:8], True))
        else:
            return
        yield pd.DataFrame([out], columns=[part.split()[0] for part in _JOB_OUT.split(", ")])


class Profiles(Expiring):
    """Totals, errors, interactions by kind and the different components of a user."""

    def __init__(self, ttl: int, threshold: int):
        super().__init__(ttl)
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.profile = handle.getValueState("profile", _PROFILE)
        self.kinds = handle.getMapState("kinds", "kind string", "n long")
        self.targets = handle.getMapState("targets", "target string", "n long")

    def row(self, key: tuple, event: str, profile: tuple, kinds: Counter) -> tuple:
        total = profile[2]
        level = "expert" if total > 3 * self.threshold else "intermediate" if total > self.threshold else "novice"
        return (key[0], event, *profile, [f"{kind}={kinds[kind]}" for kind in sorted(kinds)], level)

    def forget(self) -> None:
        self.profile.clear()
        self.kinds.clear()
        self.targets.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        profile = tuple(self.profile.get()) if self.profile.exists() else None
        kinds = Counter({k[0]: v[0] for k, v in self.kinds.iterator()}) if profile else Counter()
        if profile:
            self.handle.deleteTimer(self.due(profile[1]))
        out, added, targets = [], Counter(), Counter()

        def settle() -> tuple:
            """Put the targets gathered so far into the state; those that are new there count."""
            fresh = 0
            for target, n in targets.items():
                old = self.targets.getValue((target,))[0] if self.targets.containsKey((target,)) else 0
                fresh += old == 0
                self.targets.updateValue((target,), (old + n,))
            targets.clear()
            return (*profile[:4], profile[4] + fresh)

        for ts, _, kind, target, success in ordered(rows, timerValues.getCurrentWatermarkInMs(), "us", "seq", "interaction_type", "target_object_id", "success"):
            if profile and self.over(profile[1], ts):
                out.append(self.row(key, "closed", settle(), kinds))
                self.forget()
                profile, kinds, added = None, Counter(), Counter()
            since, last, total, errors, components = profile or (ts, ts, 0, 0, 0)
            profile = (min(since, ts), max(last, ts), total + 1, errors + (success is not None and not success), components)
            if kind is not None:
                kinds[kind] += 1
                added[kind] += 1
            if target is not None:
                targets[target] += 1
        if profile is None:
            return
        profile = settle()
        self.profile.update(profile)
        for kind in added:
            self.kinds.updateValue((kind,), (kinds[kind],))
        self.handle.registerTimer(self.due(profile[1]))
        out.append(self.row(key, "open", profile, kinds))
        yield pd.DataFrame(out, columns=[part.split()[0] for part in _PROFILE_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.profile.exists():
            return
        profile = tuple(self.profile.get())
        if expiredTimerInfo.getExpiryTimeInMs() < self.due(profile[1]):
            return
        kinds = Counter({k[0]: v[0] for k, v in self.kinds.iterator()})
        self.forget()
        yield pd.DataFrame([self.row(key, "closed", profile, kinds)], columns=[part.split()[0] for part in _PROFILE_OUT.split(", ")])


def _states(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    marked = stream.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    out = marked.groupBy(key).transformWithStateInPandas(processor, schema, "Update", "EventTime")
    return out.withColumns({name: F.timestamp_micros(name) for name in ("since", "ts")})


def job_states(stream: DataFrame, ttl: str = "24 hours", age: str = "1 hour", delay: str = "1 hour", done: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Changes of the state of each job: ``job_id, event, since, ts, status, progress, stage, max_progress, updates, artifacts``.

    ``stream``: ``job_id, ts, seq, status, progress, stage, artifact, artifact_value`` (the last two nullable).  ``event`` is
    ``open`` after each batch with rows of the job, ``stale`` when a job that is not done has not moved for ``age``,
    and ``closed`` when its state leaves after ``ttl`` without a row.  ``since`` and the job name an episode.  The row with
    the greatest ``(ts, seq)`` gives status, stage and progress; artifacts are merged by name.
    """
    return _states(stream, "job_id", JobStates(millis(ttl), millis(age), done), _JOB_OUT, delay)


def profile_states(stream: DataFrame, threshold: int = 100, ttl: str = "30 days", delay: str = "1 hour") -> DataFrame:
    """Changes of each user's profile: ``user_id, event, since, ts, total, errors, components, kinds, experience_level``.

    ``stream``: ``user_id, ts, seq, interaction_type, target_object_id, success``.  ``kinds`` holds ``type=count``;
    ``components`` is the exact number of different targets.  ``event`` is ``open`` or, after ``ttl`` without a row, ``closed``.
    """
    return _states(stream, "user_id", Profiles(millis(ttl), threshold), _PROFILE_OUT, delay)


def last_states(changes: DataFrame, key: str) -> DataFrame:
    """The last change of each episode; stale reports are left out."""
    real = changes.filter("event <> 'stale'")
    values = [c for c in real.columns if c not in (key, "since")]
    # the state leaves after its last row, so the closing of an episode is its last change
    newest = F.max_by(F.struct(*values), F.struct("updates" if "updates" in values else "total", F.col("event") == "closed"))
    return real.groupBy(key, "since").agg(newest.alias("v")).select(key, "since", "v.*")
