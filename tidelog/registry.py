"""An event-sourced schema registry: a topic of events, folded per subject.

Events are rows (offset, subject, kind, schema, id, version, level): ``register`` adds a schema,
``delete_subject``, ``delete_version`` (by version) and ``delete_id`` take away, ``config`` sets a level.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.topics import Catalog

EVENTS = "offset long, subject string, kind string, schema string, id int, version int, level string"
LEVELS = ("NONE", "BACKWARD", "FORWARD", "FULL")


def replay(events: Iterable[tuple]) -> list[tuple[int, int, str]]:
    """(version, id, schema) alive after one subject's events (offset, kind, schema, id, version) in order.

    A schema equal to the latest one alive adds none; one that was deleted does, with another version.
    """
    out: list[tuple[int, int, str]] = []
    n = 0
    for offset, kind, schema, id, version in events:
        if kind == "register" and not (out and out[-1][2] == schema):
            n += 1
            out.append((n, offset if id is None else id, schema))
        elif kind == "delete_subject":
            out, n = [], 0
        elif kind == "delete_version":
            out = [x for x in out if x[0] != version]
        elif kind == "delete_id":
            out = [x for x in out if x[1] != id]
    return out


def versions(events: DataFrame) -> DataFrame:
    """(subject, version, id, schema) that are alive. Versions count up over a subject's life and are not given again.

    A subject's events are folded in order in one task; there are as many as it ever had schemas.
    """
    own = events.where("kind IN ('register', 'delete_subject', 'delete_version')").select("subject", "offset", "kind", "schema", "id", "version")
    # deletions by id go to the subjects that have registered it
    ids = events.where("kind = 'register'").select("subject", F.coalesce("id", F.col("offset").cast("int")).alias("id")).distinct()
    gone = events.where("kind = 'delete_id'").select("offset", "kind", "schema", "id", "version").join(ids, "id").select("subject", "offset", "kind", "schema", "id", "version")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        plain = lambda c: [None if pd.isna(x) else int(x) for x in rows[c]]
        alive = replay(zip(plain("offset"), rows["kind"], rows["schema"], plain("id"), plain("version"), strict=True))
        return pd.DataFrame([(rows["subject"].iloc[0], *x) for x in alive], columns=["subject", "version", "id", "schema"])

    return own.unionByName(gone).groupBy("subject").applyInPandas(run, "subject string, version int, id int, schema string")


def latest(events: DataFrame) -> DataFrame:
    return versions(events).groupBy("subject").agg(F.max_by(F.struct("version", "id", "schema"), "version").alias("x")).select("subject", "x.*")


def by_id(events: DataFrame, id: int) -> DataFrame:
    return versions(events).where(F.col("id") == id)


def by_version(events: DataFrame, subject: str, version: int) -> DataFrame:
    return versions(events).where((F.col("subject") == subject) & (F.col("version") == version))


def subjects(events: DataFrame) -> DataFrame:
    return versions(events).select("subject").distinct().orderBy("subject")


def levels(events: DataFrame) -> DataFrame:
    """(subject, level) last set; the subject '' holds for all others."""
    return events.where("kind = 'config'").groupBy("subject").agg(F.max_by("level", "offset").alias("level"))


def required(schema: Column) -> Column:
    return F.coalesce(F.from_json(schema, "required array<string>")["required"], F.array().cast("array<string>"))


def compatible(old: Column, new: Column, level: Column) -> Column:
    """Backward: the new schema asks for nothing that the old did not; forward: the other way round."""
    backward = F.size(F.array_except(required(new), required(old))) == 0
    forward = F.size(F.array_except(required(old), required(new))) == 0
    return F.when(level == "BACKWARD", backward).when(level == "FORWARD", forward).when(level == "FULL", backward & forward).otherwise(F.lit(True))


SHOWN = "kind string, schema string, id int, version int, level string"


@dataclass
class Registry:
    """A registry that keeps its events in memory, and on a topic where it was opened on one; shows them as a DataFrame."""

    spark: SparkSession
    events: list[tuple] = field(default_factory=list)
    default: str = "NONE"
    catalog: Catalog | None = None
    topic: str = "schemas"

    @classmethod
    def open(cls, catalog: Catalog, topic: str = "schemas", default: str = "NONE") -> Registry:
        """The registry whose events a topic of one partition holds: key the subject, value JSON. It is made where there is none."""
        if topic not in [t.name for t in catalog.list()]:
            catalog.create(topic, 1)
        spark = catalog.spark
        rows = catalog.read(topic).select("offset", F.decode("key", "UTF-8").alias("subject"), F.from_json(F.decode("value", "UTF-8"), SHOWN).alias("e")).select("offset", "subject", "e.*")
        # as many rows as there ever were changes of schemas
        events = [tuple(r) for r in rows.orderBy("offset").collect()]
        return cls(spark, events, default, catalog, topic)

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.events, EVENTS)

    def _add(self, subject: str | None, kind: str, schema: str | None = None, id: int | None = None, version: int | None = None, level: str | None = None) -> int:
        offset = len(self.events)
        if self.catalog is not None:
            value = json.dumps({"kind": kind, "schema": schema, "id": id, "version": version, "level": level}).encode()
            row = self.spark.createDataFrame([(None if subject is None else subject.encode(), value, offset)], "key binary, value binary, o long")
            self.catalog.produce(self.topic, row, ["o"])
        self.events.append((offset, subject, kind, schema, id, version, level))
        return offset

    def _alive(self, subject: str) -> list[tuple[int, int, str]]:
        """(version, id, schema) alive, by the rules of ``replay``."""
        return replay((offset, kind, schema, id, version) for offset, s, kind, schema, id, version, _ in self.events if s == subject or kind == "delete_id")

    def register(self, subject: str, schema: str) -> int:
        alive = self._alive(subject)
        if alive and alive[-1][2] == schema:
            return alive[-1][1]
        if not self.check(subject, schema):
            raise ValueError("the schema is not compatible with the latest one")
        return self._add(subject, "register", schema)

    def check(self, subject: str, schema: str) -> bool:
        alive = self._alive(subject)
        if not alive:
            return True
        need = lambda x: set((json.loads(x) or {}).get("required", []) if x.strip().startswith("{") else [])
        old, new, level = need(alive[-1][2]), need(schema), self.level(subject)
        return (level not in ("BACKWARD", "FULL") or new <= old) and (level not in ("FORWARD", "FULL") or old <= new)

    def level(self, subject: str) -> str:
        found = [e[6] for e in self.events if e[2] == "config" and e[1] == subject]
        return found[-1] if found else self.default

    def set_level(self, subject: str, level: str) -> None:
        if level not in LEVELS:
            raise ValueError(f"no such level: {level}")
        self._add(subject, "config", level=level)

    def get_latest(self, subject: str) -> tuple[int, int, str] | None:
        alive = self._alive(subject)
        return alive[-1] if alive else None

    def get_version(self, subject: str, version: int) -> tuple[int, int, str] | None:
        return next((x for x in self._alive(subject) if x[0] == version), None)

    def list_versions(self, subject: str) -> list[int]:
        return [x[0] for x in self._alive(subject)]

    def list_subjects(self) -> list[str]:
        return sorted(s for s in {e[1] for e in self.events if e[1]} if self._alive(s))

    def delete_subject(self, subject: str) -> None:
        self._add(subject, "delete_subject")

    def delete_version(self, subject: str, version: int) -> None:
        self._add(subject, "delete_version", version=version)

    def delete_id(self, id: int) -> None:
        self._add(None, "delete_id", id=id)
