"""Runs as folds over their events: in batch and as a stream, with one transition function.

Events: run_id, seq long, id, previous_digest, digest, generation long, kind, timestamp, payload (JSON string). A run's
state is small and bounded by its open work; an event that may not happen rejects the run from there on, as a row, so
one bad run doesn't fail a job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Boundaries from narrow to wide, profiles, settled states of operations.
BOUNDARIES = ("observe", "propose", "mutate-worktree", "open-pr", "external-action")
PROFILES = ("bounded", "standard", "high-assurance", "exploratory")
SETTLED = ("confirmed", "failed")
_MOVES = {"planned": ("submitted", "failed"), "submitted": ("confirmed", "unknown", "failed"), "unknown": ("confirmed", "failed"), "confirmed": (), "failed": ()}
#: Kinds that an inactive run still takes.
_ALWAYS = ("checkpoint", "resumed", "operation", "cancelled")
_DIGEST = frozenset("0123456789abcdef")


class Rejected(Exception):
    """An event that may not happen; the message says why."""


def _need(condition, reason: str) -> None:
    if not condition:
        raise Rejected(reason)


def _text(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _is_digest(value) -> bool:
    return isinstance(value, str) and len(value) == 64 and set(value) <= _DIGEST


def _date(value) -> bool:
    try:
        datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return True
    except ValueError:
        return False


class Run:
    """The state of a run, and one method for each kind of event. to_json and from_json keep it between batches."""

    FIELDS = ("status", "phase", "generation", "owner", "boundary", "profile", "candidate", "revision", "budget", "observations", "rework", "operations", "criteria", "seen", "events", "reason")

    def __init__(self, boundaries=BOUNDARIES):
        self.boundaries = boundaries
        self.status, self.phase, self.generation = None, 0, 0
        self.owner = self.boundary = self.profile = self.candidate = self.revision = self.budget = self.reason = None
        self.observations: dict[str, str] = {}
        self.rework: list[str] = []
        self.operations: dict[str, list[str]] = {}
        self.criteria: list[str] | None = None
        self.seen: dict[str, str] = {}
        self.events = 0

    def to_json(self) -> str:
        return json.dumps({f: getattr(self, f) for f in self.FIELDS})

    @classmethod
    def from_json(cls, text: str) -> "Run":
        run = cls()
        for k, v in json.loads(text).items():
            setattr(run, k, v)
        return run

    def unsettled(self) -> bool:
        return any(state not in SETTLED for state, _ in self.operations.values())

    def take(self, e: dict) -> None:
        """Apply an event, or raise Rejected and stay as before. A repeat of an event that was taken changes nothing."""
        _need(_text(e["id"]) and _text(e["run_id"]), "event and run need ids")
        _need(_date(e["timestamp"]), "invalid timestamp")
        if e["id"] in self.seen:
            _need(self.seen[e["id"]] == e["digest"], "conflicting duplicate event")
            return
        _need(self.revision == e["previous_digest"], "stale event parent")
        try:
            p = json.loads(e["payload"] or "{}")
        except ValueError:
            raise Rejected("payload is not JSON") from None
        kind = e["kind"]
        if self.status is None:
            _need(kind == "started" and e["generation"] == 0, "run must start at generation zero")
            self.on_started(p)
        else:
            self._guard(e, p)
            handler = getattr(self, "on_" + kind.replace("-", "_"), None)
            _need(handler is not None and kind != "started", f"unsupported event: {kind}")
            handler(p)
        self.seen[e["id"]], self.revision = e["digest"], e["digest"]
        self.events += 1

    def _guard(self, e: dict, p: dict) -> None:
        kind = e["kind"]
        _need(e["generation"] == self.generation, "writer generation changed")
        if self.status in ("completed", "cancelled"):
            _need(kind == "operation" and p.get("kind") == "issue-projection", "terminal run cannot be changed")
        _need(self.status == "active" or kind in _ALWAYS, "paused or blocked run requires recovery")
        if self.status in ("paused", "blocked") and kind == "operation":
            stop = self.status == "paused" and p.get("kind") == "provider-safe-stop"
            _need(stop or p.get("state") in (*SETTLED, "unknown"), "inactive runs may only reconcile operations")

    def on_started(self, p):
        _need(p.get("profile") in PROFILES, "invalid profile")
        _need(p.get("boundary") in self.boundaries, "invalid action boundary")
        _need(_text(p.get("goalRef")) and _text(p.get("owner")), "goal and owner are required")
        self.status, self.profile, self.boundary, self.owner, self.budget = "active", p["profile"], p["boundary"], p["owner"], p.get("budget")

    def on_checkpoint(self, p):
        pass

    def on_contract_frozen(self, p):
        found = (p.get("contract") or {}).get("criteria") or []
        ids = [c.get("id") for c in found]
        _need(ids and p.get("sourceRevision") and all(map(_text, ids)), "contract requires criteria and source revision")
        _need(len(set(ids)) == len(ids), "duplicate acceptance criterion")
        self.criteria, self.observations = ids, {}

    def on_candidate(self, p):
        _need(_is_digest(p.get("digest")), "invalid candidate digest")
        self.candidate, self.observations = p["digest"], {}

    def on_observation(self, p):
        o = p.get("observation") or {}
        _need(o.get("candidateDigest") == self.candidate, "observation belongs to stale candidate")
        self.observations[str(o.get("digest"))] = str(o.get("outcome"))

    def on_budget_admission(self, p):
        r = p.get("result") or {}
        _need(self.budget and isinstance(r.get("admitted"), bool) and isinstance(r.get("known"), bool), "budget admission requires a budget and a result")

    def on_advanced(self, p):
        _need(not self.rework, "run blocked by rework")
        _need(not self.unsettled(), "unresolved external operation")
        _need(p.get("from") == self.phase and p.get("to") == self.phase + 1 and p["to"] <= 8, "invalid phase advancement")
        _need(_is_digest(p.get("acceptanceDigest")), "invalid acceptance digest")
        _need(p.get("candidateDigest") == self.candidate, "acceptance candidate changed")
        self.phase, self.criteria = p["to"], None

    def on_returned(self, p):
        target = 3 if self.phase == 4 else 4 if self.phase in (6, 7, 8) else None
        found = p.get("findings") or []
        _need(target is not None and p.get("to") == target and found, "invalid rework return")
        ids = [f.get("id") for f in found]
        _need(all(_text(f.get("id")) and _text(f.get("requiredChange")) for f in found), "finding needs id and change")
        _need(len(set(ids)) == len(ids) and not set(ids) & set(self.rework), "duplicate open finding")
        self.rework = [*self.rework, *ids]
        self.phase, self.criteria = target, None

    def on_rework_resolved(self, p):
        _need(p.get("id") in self.rework and p.get("observationDigests"), "rework resolution requires current evidence")
        _need(all(self.observations.get(d) == "pass" for d in p["observationDigests"]), "missing passing rework observation")
        self.rework = [x for x in self.rework if x != p["id"]]

    def _stop(self, status, p):
        _need(_text(p.get("reason")), "reason is required")
        self.status, self.reason = status, p["reason"]

    def on_paused(self, p):
        self._stop("paused", p)

    def on_blocked(self, p):
        self._stop("blocked", p)

    def on_resumed(self, p):
        _need(p.get("previousOwnerStopped") is True, "prior writer must be confirmed stopped")
        order = self.boundaries.index
        _need(p.get("boundary") in self.boundaries and order(p["boundary"]) <= order(self.boundary), "resume cannot widen authority")
        _need(not self.unsettled(), "reconcile operations before resume")
        _need(_text(p.get("owner")), "new owner is required")
        self.owner, self.boundary, self.status, self.reason = p["owner"], p["boundary"], "active", None
        self.generation += 1
        if p.get("invalidateCandidate"):
            self.candidate, self.observations = None, {}

    def on_operation(self, p):
        _need(_text(p.get("id")) and _is_digest(p.get("payloadDigest")), "operation needs id and payload digest")
        prior, state = self.operations.get(p["id"]), p.get("state")
        if prior is None:
            _need(state == "planned", "operation intent must be durable first")
        else:
            more = ("confirmed",) if prior[0] == "planned" and (p.get("reconciliation") or {}).get("state") == "confirmed" else ()
            _need(p["payloadDigest"] == prior[1] and state in (*_MOVES.get(prior[0], ()), *more), "invalid operation transition or changed payload")
        self.operations[p["id"]] = [state, p["payloadDigest"]]

    def on_completed(self, p):
        _need(self.phase == 8 and not self.rework and not self.unsettled(), "run is not complete")
        _need(_is_digest(p.get("acceptanceDigest")) and p.get("candidateDigest") == self.candidate, "final acceptance changed")
        self.status = "completed"

    def on_cancelled(self, p):
        _need(not self.unsettled(), "reconcile before cancellation")
        self.status = "cancelled"


OUT = "run_id string, status string, phase int, generation long, owner string, candidate string, contract boolean, open_rework int, open_operations int, events long, revision string, rejected string"
STATE = "state string, rejected string"


def _row(run_id: str, run: Run, rejected: str | None) -> dict:
    return {
        "run_id": run_id, "status": "rejected" if rejected else run.status, "phase": run.phase, "generation": run.generation, "owner": run.owner, "candidate": run.candidate,
        "contract": run.criteria is not None, "open_rework": len(run.rework), "open_operations": sum(s not in SETTLED for s, _ in run.operations.values()), "events": run.events, "revision": run.revision, "rejected": rejected,
    }


def _apply(run: Run, events: pd.DataFrame) -> str | None:
    for e in events.sort_values("seq", kind="stable").to_dict("records"):
        clean = {k: None if v is None or v != v else v for k, v in e.items()}
        try:
            run.take(clean)
        except Rejected as x:
            return f"{clean['id']}: {x}"
    return None


def fold_runs(events: DataFrame) -> DataFrame:
    """The state of each run after its last event, or before the first that may not happen."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        run = Run()
        return pd.DataFrame([_row(key[0], run, _apply(run, pdf))])

    return events.where(F.col("run_id").isNotNull()).groupBy("run_id").applyInPandas(fold, OUT)


def fold_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: after each micro-batch a row for each run that it touched. State is kept by run."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, rejected = state.get if state.exists else (None, None)
        run = Run.from_json(text) if text else Run()
        pdf = pd.concat(list(batches))
        if rejected is None:
            rejected = _apply(run, pdf)
        state.update((run.to_json(), rejected))
        yield pd.DataFrame([_row(key[0], run, rejected)])

    return events.where(F.col("run_id").isNotNull()).groupBy("run_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def next_action(runs: DataFrame) -> DataFrame:
    """Runs with what comes next: the first rule that holds."""
    action = (
        F.when(F.col("rejected").isNotNull(), "inspect-rejected-event").when(F.col("open_operations") > 0, "reconcile-operations").when(F.col("status").isin("completed", "cancelled"), "none")
        .when(F.col("status") != "active", "inspect-recovery").when(F.col("open_rework") > 0, "resolve-rework").when(~F.col("contract"), "freeze-contract")
        .when(F.col("candidate").isNull(), "collect-evidence").otherwise("verify-and-advance")
    )
    return runs.withColumn("next_action", action)


def append_once(batch: DataFrame, path: str, key: str = "id") -> DataFrame:
    """For foreachBatch: rows of a batch whose key isn't in the table at path yet, first writer wins; they are appended."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    if _names(spark, path):
        new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
    new.write.mode("append").parquet(path)
    return new


class Conflict(Exception):
    """The table is at another revision than its writer expected."""


def _names(spark, path: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def revision(spark, path: str) -> int:
    """Of a log that append_expected writes: the number of its appends, 0 for none."""
    return max((int(n[9:]) for n in _names(spark, path) if n.startswith("revision=")), default=0)


def append_expected(batch: DataFrame, path: str, expected: int, key: str = "id") -> int:
    """Append a batch to a log that must be at revision `expected`; returns the new revision. Rows whose key the log has
    already are left out: a writer may try again.

    The batch is written under a name that readers don't see and gets its own by a rename onto the next revision, which
    must be free: of two writers that expect the same revision one appends and the other gets a Conflict.
    """
    spark = batch.sparkSession
    if revision(spark, path) != expected:
        raise Conflict(f"{path} is at revision {revision(spark, path)}, not {expected}")
    new = batch.dropDuplicates([key])
    if expected:
        new = new.join(read_log(spark, path, batch.schema).select(key), key, "left_anti").select(*batch.columns)
    mark = uuid.uuid4().hex
    new.write.parquet(f"{path}/_{mark}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    place, to = hadoop(f"{path}/_{mark}"), hadoop(f"{path}/revision={expected + 1:012d}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(to) or not fs.rename(place, to) or fs.exists(hadoop(f"{path}/revision={expected + 1:012d}/_{mark}")):
        fs.delete(place, True)
        fs.delete(hadoop(f"{path}/revision={expected + 1:012d}/_{mark}"), True)
        raise Conflict(f"{path} got revision {expected + 1} from another writer")
    return expected + 1


def read_log(spark, path: str, schema, upto: int | None = None) -> DataFrame:
    """Rows of a log, as of a revision where one is given."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/revision=*") if revision(spark, path) else spark.createDataFrame([], schema)
    return rows if upto is None or "revision" not in rows.columns else rows.where(F.col("revision") <= upto)


def files_stream(spark, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Run events as JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


EVENTS = "run_id string, seq long, id string, previous_digest string, digest string, generation long, kind string, timestamp string, payload string"
