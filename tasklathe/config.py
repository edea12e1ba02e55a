"""Properties of a processor: registry, precedence of suppliers, changes at run time, JSON schema."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklathe.operators.scan import running


@dataclass(frozen=True)
class Definition:
    name: str
    kind: str  # long, int, bool, strings
    default: Any
    least: int | None = None
    greatest: int | None = None

    def valid(self, v: Any) -> bool:
        if self.kind == "bool":
            return isinstance(v, bool)
        if self.kind == "strings":
            return isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)
        if isinstance(v, bool) or not isinstance(v, int):
            return False
        if self.kind == "int" and not -(2**31) <= v < 2**31:
            return False
        return (self.least is None or v >= self.least) and (self.greatest is None or v <= self.greatest)


# The properties, their types, defaults and bounds.
DEFINITIONS = (
    Definition("ignore.keys", "strings", ()),
    Definition("processing.rate.per.partition", "long", -1, -1, 1_000_000),
    Definition("partition.concurrency", "int", 1, 1),
    Definition("max.pending.records", "int", 10_000, 1),
    Definition("commit.interval.ms", "long", 1000, 0),
    Definition("group.rebalance.timeout.ms", "long", 1000, 0),
    Definition("processing.shutdown.timeout.ms", "long", 0, 0),
    Definition("logging.mdc.enabled", "bool", True),
    Definition("client.metrics.micrometer.bound", "bool", False),
    Definition("deferred.complete.timeout.ms", "long", -1),
    Definition("per.key.quota.processing.rate", "long", -1, -1, 1_000_000),
    Definition("processor.threads.termination.timeout.ms", "long", 2**63 - 1, 0),
    Definition("retry.task.in.legacy.format", "bool", False),
    Definition("legacy.parse.fallback.enabled", "bool", False),
)
BY_NAME = {d.name: d for d in DEFINITIONS}
# Changing these means draining a partition and building it anew.
RELOADING = ("partition.concurrency", "max.pending.records")


class DynamicProperty:
    """A value that may change: validated, then set, then told to listeners. A bad value raises and changes nothing."""

    def __init__(self, definition: Definition, value: Any = None):
        self.definition = definition
        self._value = definition.default if value is None else self._checked(value)
        self._listeners: list[Callable[[Any, Any], None]] = []

    def _checked(self, v: Any) -> Any:
        if not self.definition.valid(v):
            raise ValueError(f"{self.definition.name}: invalid value {v!r}")
        return v

    @property
    def value(self) -> Any:
        return self._value

    def set(self, v: Any) -> Any:
        """Returns the old value, or None if it is the same."""
        old = self._value
        if self._checked(v) == old:
            return None
        self._value = v
        for listener in self._listeners:
            listener(old, v)
        return old

    def listen(self, listener: Callable[[Any, Any], None]) -> None:
        self._listeners.append(listener)
        listener(None, self._value)


class Properties:
    """Properties from suppliers: the first supplier that has one wins, defaults come last.

    ``prefix``: what the suppliers put before the names, if they do.
    """

    def __init__(self, *suppliers: dict[str, Any], prefix: str = ""):
        self._own: dict[str, DynamicProperty] = {}
        for s in suppliers:
            for name, v in s.items():
                name = name.removeprefix(prefix)
                if name not in BY_NAME:
                    raise KeyError(name)
                if name not in self._own:
                    self._own[name] = v if isinstance(v, DynamicProperty) else DynamicProperty(BY_NAME[name], v)
        for d in DEFINITIONS:
            self._own.setdefault(d.name, DynamicProperty(d))
        self.reload_requested = False
        for name in RELOADING:
            self._own[name].listen(self._ask)

    def _ask(self, old: Any, new: Any) -> None:
        self.reload_requested = self.reload_requested or old is not None

    def __getitem__(self, name: str) -> Any:
        return self._own[name].value

    def dynamic(self, name: str) -> DynamicProperty:
        return self._own[name]


def static_supplier(pairs: Iterable[tuple[str, Any]]) -> dict[str, Any]:
    """A supplier of fixed values; a property defined twice is an error."""
    out: dict[str, Any] = {}
    for name, v in pairs:
        if name in out:
            raise ValueError(f"{name} is defined twice")
        out[name] = v
    return out


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table: name, kind, default_value, least, greatest."""
    rows = [(d.name, d.kind, str(list(d.default) if d.kind == "strings" else d.default).lower(), d.least, d.greatest) for d in DEFINITIONS]
    return spark.createDataFrame(rows, "name string, kind string, default_value string, least bigint, greatest bigint")


def effective(supplied: DataFrame, spark: SparkSession) -> DataFrame:
    """Effective values of supplied settings (name, priority, value as text): the least priority wins, else the default."""
    best = supplied.filter("value is not null").groupBy("name").agg(F.min_by("value", F.struct("priority", "value")).alias("value"))
    defaults = registry(spark).select("name", "default_value")
    return defaults.join(best, "name", "left").select("name", F.coalesce("value", "default_value").alias("value"), F.col("value").isNotNull().alias("supplied"))


def changes(df: DataFrame, group: list[str], order: str, value: str, definition: Definition) -> DataFrame:
    """Values set one after the other, as the changes that listeners hear: group, order, old, new.

    An integer property: values out of its bounds (or null) are refused and
    change nothing, an equal value is no change, the first old value is the
    default.
    """
    ok = F.col(value).isNotNull()
    ok = ok & (F.col(value) >= definition.least) if definition.least is not None else ok
    ok = ok & (F.col(value) <= definition.greatest) if definition.greatest is not None else ok
    r = running(df.filter(ok).select(*group, order, F.col(value).cast("bigint").alias("new")), group, order, {"_old": ("prev", F.col("new"))})
    r = r.withColumn("old", F.coalesce("_old", F.lit(definition.default).cast("bigint")))
    return r.filter("old <> new").select(*group, order, "old", "new")


def schema_rows(spark: SparkSession, draft: str = "2020-12") -> DataFrame:
    """The JSON schema's properties as a table: name, type, minimum, maximum, default_value (as JSON)."""
    rows = [(n, p["type"], p.get("minimum"), p.get("maximum"), json.dumps(p["default"])) for n, p in json_schema(draft)["properties"].items()]
    return spark.createDataFrame(rows, "name string, type string, minimum bigint, maximum bigint, default_value string")


# The JSON-schema drafts that can be written.
DRAFTS = {
    "draft-07": "http://json-schema.org/draft-07/schema#",
    "2019-09": "https://json-schema.org/draft/2019-09/schema",
    "2020-12": "https://json-schema.org/draft/2020-12/schema",
}


def json_schema(draft: str = "2020-12", additional: bool = False) -> dict:
    """JSON schema of a property file: a flat object of the registry's properties."""
    props = {}
    for d in DEFINITIONS:
        p: dict[str, Any] = {"bool": {"type": "boolean"}, "strings": {"type": "array", "items": {"type": "string"}}}.get(d.kind, {"type": "integer"})
        p = dict(p, default=list(d.default) if d.kind == "strings" else d.default)
        if d.least is not None:
            p["minimum"] = d.least
        if d.greatest is not None:
            p["maximum"] = d.greatest
        props[d.name] = p
    return {"$schema": DRAFTS[draft], "type": "object", "properties": props, "additionalProperties": additional}
