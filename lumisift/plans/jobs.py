"""Requests, stage switches and the state machine of jobs, on the driver."""

from __future__ import annotations

import re
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

# Limits and defaults of a request.
PIXELS = (65_536, 100_000_000)
MODELS = ("dinov3", "pixai")
TARGET_KEYS = {"people": ("1", "2", "3_plus"), "framing": ("full_body", "half_body", "headshot"), "outdoors": ("true", "false")}
TARGETS = {"people": {"1": 0.85, "2": 0.12, "3_plus": 0.03}, "framing": {"full_body": 0.30, "half_body": 0.50, "headshot": 0.20}, "outdoors": {"true": 0.40, "false": 0.60}}


@dataclass(frozen=True)
class Stages:
    deduplicate: bool = True
    resolution_filter: bool = True
    embedding: bool = True
    clustering: bool = True
    graph: bool = True
    locate: bool = True
    retry: bool = True

    def effective(self) -> "Stages":
        """Without embedding neither clusters nor graph; without inspection no retry."""
        return replace(self, clustering=self.clustering and self.embedding, graph=self.graph and self.embedding, retry=self.retry and self.locate)


def between(low, high):
    return lambda v: v is None or low <= v <= high


def shares_of(keys: tuple[str, ...]):
    """A check of target shares: exactly these keys, none negative, not all 0."""
    return lambda t: t is not None and sorted(t) == sorted(keys) and all(v >= 0 for v in t.values()) and any(v > 0 for v in t.values())


def checked(request, rules: dict) -> None:
    """Raise for the first field (a dotted name leads into a map) whose value breaks its rule (test, what it must be)."""
    for name, (holds, what) in rules.items():
        first, _, key = name.partition(".")
        value = getattr(request, first)
        if not holds(value.get(key) if key else value):
            raise ValueError(f"{name} must be {what}")


@dataclass(frozen=True)
class JobRequest:
    source_dir: str
    output_dir: str | None = None
    similarity_model: str = "dinov3"
    minimum_pixels: int | None = None
    linkage: float | None = None
    graph_similarity: float | None = None
    seed: int | None = None
    stages: Stages = field(default_factory=Stages)

    def __post_init__(self):
        checked(self, JOB_RULES)


@dataclass(frozen=True)
class FinalizeRequest:
    prefix: str
    target_size: int
    targets: dict = field(default_factory=lambda: TARGETS)
    caption_threshold: float = 0.50
    denylist: tuple[str, ...] = ()

    def __post_init__(self):
        entries = dict.fromkeys(filter(None, map(str.strip, self.denylist)))
        vars(self).update(prefix=self.prefix.strip(), denylist=tuple(sorted(entries, key=lambda x: (x.casefold(), x))))
        checked(self, FINALIZE_RULES)


JOB_RULES = {
    "source_dir": (str.strip, "a folder"),
    "similarity_model": (MODELS.__contains__, f"one of {MODELS}"),
    "minimum_pixels": (between(*PIXELS), "within {}..{}".format(*PIXELS)),
    "linkage": (between(0, 1), "within 0..1"),
    "graph_similarity": (between(0, 1), "within 0..1"),
}
FINALIZE_RULES = {
    **{f"targets.{d}": (shares_of(keys), f"shares of {keys}, none negative, with a positive sum") for d, keys in TARGET_KEYS.items()},
    "denylist": (lambda v: len(v) <= 500, "at most 500 entries"),
    "caption_threshold": (between(0.05, 0.95), "within .05...95"),
    "target_size": (between(1, 10_000), "within 1..10000"),
    "prefix": (re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}").fullmatch, "1 to 64 letters, digits, - or _, not starting with - or _"),
}


class Job:
    """A job's mutable state; ``events`` is its log, numbered from 1."""

    def __init__(self, request):
        self.job_id, self.request = uuid.uuid4().hex[:12], request
        self.status, self.curation, self.error = "queued", "not_started", None
        self.events, self.lock, self.result = [], threading.RLock(), None

    def event(self, stage: str, status: str, progress: float, message: str = "", **data):
        with self.lock:
            self.events.append({"job_id": self.job_id, "id": len(self.events) + 1, "stage": stage, "status": status, "message": message, "progress": progress, "data": data})


class Jobs:
    """Runs jobs two at a time. ``pipeline(job)`` filters, ``tagger(job)`` tags, ``finisher(job, request)`` writes the set."""

    def __init__(self, pipeline, tagger=None, finisher=None, workers: int = 2):
        self.steps, self.jobs, self.pool = (pipeline, tagger, finisher), {}, ThreadPoolExecutor(workers)

    def _run(self, job: Job, start: dict, work, done: dict, failed: dict):
        with job.lock:
            vars(job).update(start)
        try:
            result = work()
            with job.lock:
                job.result = result
                vars(job).update(done)
        except Exception as e:  # a failed job is a state, not a crash
            with job.lock:
                job.error = str(e)
                vars(job).update(failed)
            job.event("job", "failed", 1.0, str(e))

    def submit(self, request) -> Job:
        job = Job(request)
        self.jobs[job.job_id] = job
        self.pool.submit(self._run, job, {"status": "running"}, lambda: self.steps[0](job), {"status": "completed"}, {"status": "failed"})
        return job

    def newest_first(self) -> list[Job]:
        return list(self.jobs.values())[::-1]

    def curate(self, job: Job):
        """Tagging; a failure leaves the job completed, to be tagged again."""
        with job.lock:
            if job.status != "completed" or job.curation not in ("not_started", "failed"):
                raise ValueError("the job is not ready for tagging")
            job.curation, job.status = "tagging", "running"
        return self.pool.submit(self._run, job, {}, lambda: self.steps[1](job), {"status": "awaiting_selection", "curation": "awaiting_selection"}, {"status": "completed", "curation": "failed"})

    def finalize(self, job: Job, request: FinalizeRequest):
        """Selection and writing; a failure returns the job to awaiting selection."""
        with job.lock:
            if job.status != "awaiting_selection":
                raise ValueError("the job is not awaiting selection")
            job.curation, job.status = "finalizing", "running"
        return self.pool.submit(self._run, job, {}, lambda: self.steps[2](job, request), {"status": "completed", "curation": "completed"}, {"status": "awaiting_selection", "curation": "awaiting_selection"})
