"""What the indexer has done: phase, counters, the last errors, churn, and a log of JSON lines."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter, deque
from pathlib import Path

#: Outcomes that are counted, errors that are kept, and changes that the churn window holds at most.
OUTCOMES = ("indexed", "skipped", "excluded", "unsupported", "too_big", "deleted", "failed")
ERRORS, CHANGES, TOP = 8, 5_000, 20


class JsonLog:
    """One JSON object a line; a file that reaches ``max_bytes`` becomes the one old generation (0: no limit)."""

    def __init__(self, path: str, max_bytes: int = 0) -> None:
        self.path, self.max_bytes, self.lock = Path(path), max_bytes, threading.Lock()

    def write(self, event: str, **fields) -> None:
        line = json.dumps({"ts": time.time(), "event": event, **fields}, default=str) + "\n"
        with self.lock:
            self.path.parent.mkdir(parents=True, exist_ok=True)
            if self.max_bytes and self.path.exists() and self.path.stat().st_size + len(line) > self.max_bytes:
                self.path.replace(self.path.with_name(self.path.name + ".1"))
            with self.path.open("a") as f:
                f.write(line)


class Status:
    """Counters of one process; safe to use from several threads."""

    def __init__(self, window_s: int = 600, log: JsonLog | None = None, clock=time.time) -> None:
        self.window_s, self.log, self.clock = window_s, log, clock
        self.lock, self.began, self.phase = threading.RLock(), clock(), "idle"
        self.counts: Counter = Counter()
        self.by_root: dict[str, Counter] = {}
        self.errors: deque = deque(maxlen=ERRORS)
        self.changes: deque = deque(maxlen=CHANGES)
        self.beat: Counter = Counter()

    def _say(self, event: str, **fields) -> None:
        if self.log:
            self.log.write(event, **fields)

    def enter(self, phase: str) -> None:
        with self.lock:
            self.phase = phase
        self._say("phase", phase=phase)

    def count(self, outcome: str, n: int = 1, root: str | None = None) -> None:
        if outcome not in OUTCOMES:
            raise ValueError(f"unknown outcome {outcome}")
        with self.lock:
            self.counts[outcome] += n
            if root is not None:
                self.by_root.setdefault(root, Counter())[outcome] += n

    def failed(self, path: str, error: object) -> None:
        """An error; the last few are kept."""
        with self.lock:
            self.count("failed")
            self.errors.append({"ts": self.clock(), "path": path, "error": str(error)})
        self._say("error", path=path, error=str(error))

    def changed(self, path: str, kind: str, root: str = "other", ts: float | None = None) -> None:
        with self.lock:
            self.changes.append((self.clock() if ts is None else ts, path, root, kind))

    def churn(self) -> dict:
        """Counts in the window by path (the most frequent ones), root and kind, and changes a minute."""
        with self.lock:
            since = self.clock() - self.window_s
            while self.changes and self.changes[0][0] < since:
                self.changes.popleft()
            rows = list(self.changes)
        by = lambda k: Counter(r[k] for r in rows)
        top = sorted(by(1).items(), key=lambda x: (-x[1], x[0]))[:TOP]
        return {"events": len(rows), "per_min": len(rows) * 60 / self.window_s if self.window_s else 0.0, "by_path": dict(top), "by_root": dict(by(2)), "by_kind": dict(by(3))}

    def heartbeat(self) -> dict:
        """What was counted since the last beat; empty, and not logged, if nothing was."""
        with self.lock:
            delta = {k: n - self.beat[k] for k, n in self.counts.items() if n != self.beat[k]}
            self.beat = Counter(self.counts)
        if delta:
            self._say("heartbeat", **delta)
        return delta

    def snapshot(self) -> dict:
        with self.lock:
            return {"phase": self.phase, "uptime_s": int(self.clock() - self.began), "counts": {o: self.counts[o] for o in OUTCOMES}, "by_root": {r: dict(c) for r, c in self.by_root.items()}, "errors": list(self.errors), "churn": self.churn()}
