"""Running several streams together, and what watches them: a runner with a soft and a hard stop and the first error, a batcher of single
records, counters of batches that are being worked on, run-time rates, and a report of metrics.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger("millrace")


def logs_to(sink: Callable[[str], None] | None, level: int = logging.INFO) -> logging.Logger:
    """Sends the engine's log lines, as JSON objects, to a callable; None takes such handlers away again."""

    class Lines(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            sink(json.dumps({"level": record.levelname, "at": round(record.created, 3), "logger": record.name, "message": record.getMessage()}))

    log.handlers = [h for h in log.handlers if type(h).__name__ != "Lines"]
    if sink:
        log.addHandler(Lines())
        log.setLevel(level)
    return log


class Runner:
    """Operators that run side by side: streaming queries, and callables that take a stop event. The first error stops all softly.

    add() before or after start(); wait() returns when all have ended and raises the first error.
    """

    def __init__(self, name: str = "runner") -> None:
        self.name, self.parts, self.stopping, self.hard = name, [], threading.Event(), threading.Event()
        self.error: BaseException | None = None
        self.done, self.lock, self.left, self.exits, self.started = threading.Event(), threading.Lock(), 0, [], False

    def add(self, part: StreamingQuery | Callable[[threading.Event], None]) -> Runner:
        with self.lock:
            self.parts.append(part)
            if self.started:
                self._launch(part)
        return self

    def on_exit(self, hook: Callable[[], None]) -> Runner:
        """Called once, when all parts have ended, in the order of the calls."""
        self.exits.append(hook)
        return self

    def start(self) -> Runner:
        with self.lock:
            if self.started:
                raise RuntimeError(f"{self.name} runs already")
            self.started = True
            for part in self.parts:
                self._launch(part)
            if not self.parts:
                self._finish()
        return self

    def _launch(self, part: object) -> None:
        self.left += 1
        threading.Thread(target=self._run, args=(part,), daemon=True, name=self.name).start()

    def _run(self, part: object) -> None:
        try:
            if isinstance(part, StreamingQuery) or hasattr(part, "processAllAvailable"):
                self._follow(part)
            else:
                part(self.stopping)
        except BaseException as e:  # noqa: BLE001  (kept and raised by wait)
            with self.lock:
                self.error = self.error or e
            log.error("%s: %s", self.name, e)
            self.stopping.set()
        finally:
            with self.lock:
                self.left -= 1
                last = not self.left
            if last:
                self._finish()

    def _follow(self, query: StreamingQuery) -> None:
        while not query.awaitTermination(0.1):
            if self.hard.is_set():
                query.stop()
            elif self.stopping.is_set():
                query.processAllAvailable()
                query.stop()

    def _finish(self) -> None:
        for hook in self.exits:
            try:
                hook()
            except BaseException as e:  # noqa: BLE001
                self.error = self.error or e
        self.done.set()

    def soft_stop(self) -> None:
        """Everything takes in what its source has, then ends."""
        self.stopping.set()

    def hard_stop(self) -> None:
        self.hard.set()
        self.stopping.set()

    def wait(self, timeout: float | None = None) -> bool:
        """Whether all have ended within the time; raises the first error."""
        if not self.done.wait(timeout):
            return False
        if self.error:
            raise self.error
        return True


class Batcher:
    """Gathers single records into batches for a callback that has room for ``credit`` batches at once.

    The first record of a batch waits for ``first_wait`` seconds, then the batch goes, but ``between`` seconds after the one before at
    the earliest; a batch of ``most`` records goes at once. Without credit nothing goes, and the batch grows (with ``most``, add() waits
    then). close() sends what is left.
    """

    def __init__(self, send: Callable[[list], None], first_wait: float = 1.0, between: float = 1.0, most: int | None = None, credit: int = 1, clock: Callable[[], float] = time.monotonic) -> None:
        self.send, self.first_wait, self.between, self.most, self.clock = send, first_wait, between, most, clock
        self.held: list = []
        self.since: float | None = None
        self.last, self.credit, self.batches, self.records = -float("inf"), credit, 0, 0
        self.changed = threading.Condition()

    def add(self, record: object) -> None:
        with self.changed:
            while self.most and len(self.held) >= self.most and not self.credit:
                self.changed.wait()
            self.held.append(record)
            self.since = self.clock() if self.since is None else self.since
        self.tick()

    def due(self) -> float | None:
        """Seconds until the batch at hand goes; None if there is none or no credit."""
        with self.changed:
            if not self.held or self.credit <= 0:
                return None
            if self.most and len(self.held) >= self.most:
                return 0.0
            return max(0.0, max(self.since + self.first_wait, self.last + self.between) - self.clock())

    def tick(self) -> bool:
        """Sends the batch if it is due."""
        if self.due() == 0:
            self._flush()
            return True
        return False

    def done(self, batches: int = 1) -> None:
        """The receiver has worked off batches: it has room for as many more."""
        with self.changed:
            self.credit += batches
            self.changed.notify_all()
        self.tick()

    def _flush(self) -> None:
        with self.changed:
            batch, self.held, self.since, self.last = self.held, [], None, self.clock()
            self.credit -= 1
            self.batches += 1
            self.records += len(batch)
            self.changed.notify_all()
        self.send(batch)

    def close(self) -> None:
        """Sends what is left, with credit or without."""
        if self.held:
            self._flush()


def batched(records: Iterable, size: int) -> Iterator[list]:
    """Lists of size records; the last may be shorter."""
    held: list = []
    for record in records:
        held.append(record)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


class InFlight:
    """Counts what is being worked on. notify() takes one more, done() gives some back; wait_below blocks until there is room.

    wait_below(n) with several waiters wakes all of them; changes between two looks count once."""

    def __init__(self) -> None:
        self.count, self.most, self.changed = 0, 0, threading.Condition()

    def notify(self, n: int = 1) -> None:
        with self.changed:
            self.count += n
            self.most = max(self.most, self.count)
            self.changed.notify_all()

    def done(self, n: int = 1) -> None:
        with self.changed:
            if n > self.count:
                raise ValueError("more has ended than has begun")
            self.count -= n
            self.changed.notify_all()

    def wait_below(self, n: int = 1, timeout: float | None = None) -> bool:
        with self.changed:
            return self.changed.wait_for(lambda: self.count < n, timeout)


class Rate:
    """Items and their rate since the counter began."""

    def __init__(self, name: str, clock: Callable[[], float] = time.monotonic) -> None:
        self.name, self.clock, self.items, self.began = name, clock, 0, clock()
        self.lock = threading.Lock()

    def add(self, n: int = 1) -> None:
        with self.lock:
            self.items += n

    def per_second(self) -> float:
        return self.items / max(1e-9, self.clock() - self.began)

    def line(self) -> str:
        return f"{self.name}: {self.items} items in {self.clock() - self.began:.1f} s, {self.per_second():.1f} a second"


@dataclass
class Report:
    """Counters by operator for a process with a name: events, errors, and for each the last values; with its uptime."""

    name: str
    clock: Callable[[], float] = time.time
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    began: float | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self) -> None:
        self.began = self.clock()

    def event(self, op: str, n: int = 1, error: bool = False) -> None:
        with self._lock:
            own = self.counts.setdefault(op, {"events": 0, "errors": 0})
            own["events"] += n
            own["errors"] += n if error else 0

    def merge(self, rows: Iterable[tuple[str, int, int]]) -> Report:
        """Adds op, events, errors, as tasks have summed them."""
        for op, events, errors in rows:
            with self._lock:
                own = self.counts.setdefault(op, {"events": 0, "errors": 0})
                own["events"] += events
                own["errors"] += errors
        return self

    def say(self) -> dict:
        with self._lock:
            return {"name": self.name, "uptime": round(self.clock() - self.began, 3), "operators": {k: dict(v) for k, v in sorted(self.counts.items())}}

    def every(self, seconds: float, sink: Callable[[str], None], stopping: threading.Event) -> None:
        """Says so to the sink again and again, and once more at the end. A part for a Runner."""
        while not stopping.wait(seconds):
            sink(json.dumps(self.say()))
        sink(json.dumps(self.say()))
