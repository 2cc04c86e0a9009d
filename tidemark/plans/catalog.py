"""Databases with their measurements, retention policies and continuous queries, kept as JSON beside the tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, replace
from datetime import datetime, timezone
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durations import instant
from tidemark.plans.measurement import Measurement
from tidemark.sources import files
from tidemark.sources.line_protocol import parse_lines
from tidemark.sources.store import read_table, write_points
from tidemark.streaming.continuous import ContinuousQuery
from tidemark.streaming.lifecycle import Downsample, RetentionPolicy, enforce

T = TypeVar("T")
#: Versions of a catalog that stay after a change.
KEPT = 10


class Catalog:
    """A folder of databases in any file system that Spark reaches.

    Each change of a database's catalog is a new version, a file that appears by one rename under a number that must be free: readers see
    one version or the next, and of two writers the later one repeats its change on what the other has made.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, db: str) -> list[int]:
        return [int(n[1:11]) for n in files.names(self.spark, f"{self.root}/{db}/_catalog") if n.startswith("v")]

    def _load(self, db: str) -> dict:
        return self._latest(db)[1]

    def _latest(self, db: str) -> tuple[int, dict]:
        version = max(self._versions(db), default=0)
        if not version:
            raise KeyError(f"no database {db!r}")
        return version, json.loads(files.read_text(self.spark, f"{self.root}/{db}/_catalog/v{version:010d}.json"))

    def _put(self, db: str, version: int, state: dict) -> None:
        files.put_once(self.spark, f"{self.root}/{db}/_catalog/v{version:010d}.json", json.dumps(state))
        for old in self._versions(db):
            if old <= version - KEPT:
                files.remove(self.spark, f"{self.root}/{db}/_catalog/v{old:010d}.json")

    def _change(self, db: str, change: Callable[[dict], T]) -> T:
        """Applies a change to the latest version; again, if another writer was faster."""
        while True:
            version, state = self._latest(db)
            out = change(state)
            try:
                self._put(db, version + 1, state)
            except files.NameTaken:
                continue
            return out

    def databases(self) -> list[str]:
        return [n for n in files.names(self.spark, self.root) if self._versions(n)]

    def create_database(self, db: str, if_not_exists: bool = False) -> None:
        try:
            if not self._versions(db):
                return self._put(db, 1, {"measurements": {}, "policies": {}, "queries": {}})
        except files.NameTaken:
            pass
        if not if_not_exists:
            raise ValueError(f"database {db!r} exists")

    def drop_database(self, db: str, if_exists: bool = False) -> None:
        if db not in self.databases():
            if if_exists:
                return
            raise KeyError(f"no database {db!r}")
        files.remove(self.spark, f"{self.root}/{db}")

    def write(self, db: str, points: DataFrame, width: str = "1d") -> None:
        """Appends points, creating the database and measurements that aren't there."""
        self.create_database(db, if_not_exists=True)
        made = write_points(points, f"{self.root}/{db}", width)
        self._change(db, lambda state: [_declare(state, name, tags, fields) for name, (tags, fields) in made.items()])

    def write_lines(self, db: str, lines: DataFrame, unit: str = "ns") -> None:
        self.write(db, parse_lines(lines, unit))

    def measurements(self, db: str) -> list[str]:
        return sorted(self._load(db)["measurements"])

    def measurement(self, db: str, name: str) -> Measurement:
        own = self._load(db)["measurements"].get(name)
        if own is None:
            raise KeyError(f"no measurement {name!r}")
        return read_table(self.spark, f"{self.root}/{db}/{name}", name, tuple(own["tags"]), tuple(own["fields"]))

    def drop_measurement(self, db: str, name: str) -> None:
        if self._change(db, lambda state: state["measurements"].pop(name, None)) is None:
            raise KeyError(f"no measurement {name!r}")
        files.remove(self.spark, f"{self.root}/{db}/{name}")

    def tag_keys(self, db: str, name: str | None = None) -> list[str]:
        found = self._load(db)["measurements"]
        return sorted({t for n, m in found.items() if name in (None, n) for t in m["tags"]})

    def field_keys(self, db: str, name: str | None = None) -> list[str]:
        found = self._load(db)["measurements"]
        return sorted({t for n, m in found.items() if name in (None, n) for t in m["fields"]})

    def all_points(self, db: str) -> DataFrame:
        """measurement and time of every point of a database: one scan for each measurement."""
        parts = [self.measurement(db, n).df.select(F.lit(n).alias("measurement"), "time", "time_ns") for n in self.measurements(db)]
        if not parts:
            return self.spark.createDataFrame([], "measurement string, time timestamp_ntz, time_ns bigint")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # Retention policies

    def policies(self, db: str) -> list[RetentionPolicy]:
        made = []
        for p in self._load(db)["policies"].values():
            d = p.get("downsample")
            made.append(RetentionPolicy(**{**p, "downsample": Downsample(d["every"], tuple(d["aggregates"]), d["suffix"]) if d else None}))
        return sorted(made, key=lambda p: p.name)

    def _put_policy(self, db: str, policy: RetentionPolicy, new: bool = False) -> None:
        def put(state: dict) -> None:
            if new and policy.name in state["policies"]:
                raise ValueError(f"policy {policy.name!r} exists")
            if policy.default:
                for p in state["policies"].values():
                    p["default"] = False
            state["policies"][policy.name] = asdict(policy)

        self._change(db, put)

    def create_policy(self, db: str, policy: RetentionPolicy) -> None:
        self._put_policy(db, policy, new=True)

    def alter_policy(self, db: str, name: str, **changes) -> RetentionPolicy:
        """Changes what is given; a new default takes the place of the old one."""
        old = next((p for p in self.policies(db) if p.name == name), None)
        if old is None:
            raise KeyError(f"no policy {name!r}")
        new = replace(old, **{k: v for k, v in changes.items() if v is not None})
        self._put_policy(db, new)
        return new

    def drop_policy(self, db: str, name: str) -> None:
        """A default policy can't be dropped while there are others."""

        def drop(state: dict) -> None:
            if name not in state["policies"]:
                raise KeyError(f"no policy {name!r}")
            if state["policies"][name]["default"] and len(state["policies"]) > 1:
                raise ValueError("the default policy can't be dropped while others exist")
            del state["policies"][name]

        self._change(db, drop)

    def enforce(self, db: str, now, width: str = "1d") -> dict[str, list[int]]:
        """Applies the policies to all measurements of a database."""
        return {n: enforce(self.measurement(db, n), f"{self.root}/{db}/{n}", self.policies(db), now, width) for n in self.measurements(db)}

    # Continuous queries

    def queries(self, db: str) -> list[ContinuousQuery]:
        found = self._load(db)["queries"].values()
        return sorted((ContinuousQuery(**{**q["query"], "by": None if q["query"]["by"] is None else tuple(q["query"]["by"])}) for q in found), key=lambda q: q.name)

    def create_query(self, cq: ContinuousQuery) -> None:
        def create(state: dict) -> None:
            if cq.name in state["queries"]:
                raise ValueError(f"continuous query {cq.name!r} exists")
            state["queries"][cq.name] = {"query": asdict(cq), "processed": None, "last_run": None}

        self._change(cq.database, create)

    def drop_query(self, db: str, name: str) -> None:
        if self._change(db, lambda state: state["queries"].pop(name, None)) is None:
            raise KeyError(f"no continuous query {name!r}")

    def enable_query(self, db: str, name: str, enabled: bool = True) -> None:
        self._change(db, lambda state: state["queries"][name]["query"].update(enabled=enabled))

    def query_status(self, db: str, name: str) -> dict:
        q = self._load(db)["queries"][name]
        return {"enabled": q["query"]["enabled"], "processed": q["processed"], "last_run": q["last_run"]}

    def run_queries(self, db: str, now) -> list[str]:
        """One turn of each enabled query; which ran. After a failure, the next turn ends what the failed one began, so that no bucket is there twice."""
        ran = []
        for cq in self.queries(db):
            if not cq.enabled:
                continue
            at = self._load(db)["queries"][cq.name]["processed"]
            m = self.measurement(db, cq.source)
            path = f"{self.root}/{db}/{cq.destination}"
            end = cq.run(m, path, now, instant(at) if at else None)

            def record(state: dict) -> None:
                state["queries"][cq.name] |= {"processed": end.isoformat(), "last_run": instant(now).isoformat()}  # noqa: B023
                _declare(state, cq.destination, cq.tags(m), (cq.field,))  # noqa: B023

            self._change(db, record)
            cq.forget(self.spark, path)
            ran.append(cq.name)
        return ran

    def keep_running(self, db: str, every: float, stop: Callable[[], bool], clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> int:
        """Runs the queries and the policies' retention every ``every`` seconds until ``stop()``; how many turns. A turn that fails is repeated by the next one."""
        turns = 0
        while not stop():
            self.run_queries(db, clock())
            self.enforce(db, clock())
            turns += 1
            time.sleep(every)
        return turns


def _declare(state: dict, name: str, tags, fields) -> None:
    own = state["measurements"].setdefault(name, {"tags": [], "fields": []})
    own["tags"], own["fields"] = sorted({*own["tags"], *tags}), sorted({*own["fields"], *fields})
    if clash := set(own["tags"]) & set(own["fields"]):
        raise ValueError(f"{sorted(clash)} are tags and fields of {name!r}")
