"""Who holds the versions (eras) of the node list: one that never changes, and one that asks hosts again and again."""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import routing

#: Fixed value: seconds between two requests.
EVERY = 60.0


@dataclass(frozen=True)
class Node:
    name: str
    ip: str
    port: int
    disk: float
    load: float = 0.0

    @property
    def weight(self) -> int:
        return routing.LOW_WEIGHT if self.disk < routing.LOW_DISK else routing.WEIGHT


@dataclass(frozen=True)
class Era:
    nodes: tuple[Node, ...]

    def slots(self, spark: SparkSession) -> DataFrame:
        """slot, node of this era."""
        rows = [(n.name, n.weight) for n in self.nodes]
        return routing.slots(spark.createDataFrame(rows, "node string, weight int"))


def parsed(text: str | bytes) -> Era:
    """An era from a host's answer: {"Nodes": [{"Name", "Ip", "Port", "Disk_free", "Load"}]}."""
    return Era(tuple(Node(n["Name"], n["Ip"], int(n["Port"]), float(n["Disk_free"]), float(n.get("Load", 0))) for n in json.loads(text)["Nodes"]))


class StaticEras:
    """One era for all times."""

    def __init__(self, era: Era) -> None:
        self.era = era

    def at(self, t: int) -> Era:
        return self.era

    def current(self) -> Era:
        return self.era


def fetch(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=10) as answer:  # noqa: S310  (the hosts are the caller's)
        return answer.read()


class PolledEras:
    """Asks the hosts in turn, of which the first good answer counts, and keeps the newest eras. Raises if no host answers the first time;
    later the last era stays current, and ``errors`` grows."""

    def __init__(self, hosts: list[str], every: float = EVERY, kept: int = routing.ERAS, fetch: Callable[[str], str | bytes] = fetch, clock: Callable[[], float] = time.time) -> None:
        self.hosts, self.every, self.kept, self.fetch, self.clock = hosts, every, kept, fetch, clock
        self.eras: dict[int, Era] = {}
        self.errors: list[str] = []
        self.lock, self.stopping = threading.Lock(), threading.Event()
        if not self.poll():
            raise ConnectionError(f"no host has a list of nodes: {self.errors}")

    def poll(self) -> bool:
        """Whether some host gave an era."""
        for host in self.hosts:
            try:
                era = parsed(self.fetch(host))
            except (OSError, ValueError, KeyError, TypeError) as e:
                self.errors.append(f"{host}: {e}")
                continue
            with self.lock:
                t = int(self.clock())
                self.eras[max(t, max(self.eras, default=t))] = era
                for old in sorted(self.eras)[: -self.kept]:
                    del self.eras[old]
            return True
        return False

    def run(self, stopping: threading.Event) -> None:
        """A part for a Runner: polls until it is told to stop."""
        while not stopping.wait(self.every):
            self.poll()

    def at(self, t: int) -> Era:
        """The era of exactly this time, else the current one."""
        with self.lock:
            return self.eras.get(t) or self.eras[max(self.eras)]

    def current(self) -> Era:
        with self.lock:
            return self.eras[max(self.eras)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """t, era (the era's time as text), slot, node: what routes records by era."""
        with self.lock:
            found = [(t, e) for t, e in sorted(self.eras.items())]
        rows = [(t, str(t), r["slot"], r["node"]) for t, e in found for r in e.slots(spark).collect()]  # 100 rows an era
        return spark.createDataFrame(rows, "t bigint, era string, slot int, node string")
