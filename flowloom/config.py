"""Engine settings and the sticky request."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import datetime


DATES = "%Y%m%d%H%M%S"
# Names of settings in a properties file.
KEYS = {"firstDate": "first_date", "lastDate": "last_date", "intervalMS": "interval_ms", "minimumDuration": "minimum_days", "initialDuration": "initial_days", "fixedInterval": "fixed_days"}


@dataclass
class EngineConfig:
    first_date: datetime = datetime(1995, 1, 1)
    last_date: datetime = datetime(2001, 8, 1)
    interval_ms: int = 500
    minimum_days: int = 1
    initial_days: int = 2
    fixed_days: int = 60
    #: Squared length in degrees up to which an edge counts as degenerate.
    least_length2: float = 0.001
    k: int = 17
    min_zoom: int = 0
    max_zoom: int = 17
    #: How places become clusters where a request asks for the greedy hierarchy: "pairs" inserts edge by edge, "tiles" approximates it in one pass.
    hierarchy: str = "tiles"
    #: Distinct edges above which bundling becomes incremental, if the request asks for it.
    incremental_above: int = 1000
    compatibility: float = 0.6
    #: Edges of one component of compatible edges above which it is bundled in blocks of as many.
    bundling_block: int = 20000

    @classmethod
    def parsed(cls, properties: str, base: EngineConfig | None = None) -> EngineConfig:
        """Settings of a properties text (key=value lines, # and ! start comments) over those of `base`; unknown keys are ignored.

        Keys are KEYS or this class's own names; dates look like 20151117213452.
        """
        given = dict(vars(base or cls()))
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        for line in properties.splitlines():
            key, found, value = line.strip().partition("=")
            name, value = KEYS.get(key.strip(), key.strip()), value.strip()
            if found and key[:1] not in ("#", "!") and name in kinds:
                given[name] = datetime.strptime(value, DATES) if kinds[name] is datetime else kinds[name](value)
        return cls(**given)

    @classmethod
    def read(cls, spark, path: str, base: EngineConfig | None = None) -> EngineConfig:
        """parsed() of a file that Spark can read; a missing one leaves the settings of `base`."""
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return base or cls()
        return cls.parsed("\n".join(r["value"] for r in spark.read.text(path).collect()), base)


@dataclass
class Request:
    """A request keeps the values of the one before for every key that is absent; values may arrive as text."""

    query: str = ""
    pointStatus: int = 1
    edgeStatus: int = 1
    clustering: int = 0
    clusteringAlgorithm: int = 0
    bundling: int = 0
    bundlingAlgorithm: int = 0
    treeCut: int = 0
    zoom: int = 4
    lowerLongitude: float = -180.0
    upperLongitude: float = 180.0
    lowerLatitude: float = -90.0
    upperLatitude: float = 90.0
    radius: float = 40.0
    newQuery: bool = True

    def update(self, message: str | dict) -> Request:
        """Takes over the keys that are present. An empty message (a heartbeat) changes nothing."""
        given = json.loads(message) if isinstance(message, str) and message.strip() else message or {}
        for f in fields(self):
            if f.name in given:
                kind, value = type(getattr(self, f.name)), given[f.name]
                if kind is bool and isinstance(value, str):
                    value = value.strip().lower() == "true"
                setattr(self, f.name, kind(value))
        return self


@dataclass
class Result:
    """One response: flag N until the query is done, then Y; points and edges stay DataFrames."""

    flag: str
    points: object = None
    edges: object = None
    counters: dict = field(default_factory=dict)
