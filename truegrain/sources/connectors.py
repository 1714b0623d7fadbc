"""Service connectors (S23-S27, U6, F22, P16): requests and the transforms of
their replies."""

from __future__ import annotations

import json
import re
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import make, retry
from .readers import parsed

Fetch = Callable[[str, dict[str, str]], dict]
IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)*")


def http_json(url: str, headers: dict[str, str]) -> dict:
    def get() -> dict:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as reply:
            return json.load(reply)

    return retry(get)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields as columns ``a_b_c``; arrays go."""

    def fields(schema: T.StructType, path: str, name: str) -> Iterator:
        for f in schema:
            at, label = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from fields(f.dataType, f"{at}.", f"{label}{sep}")
            elif not isinstance(f.dataType, T.ArrayType):
                yield F.col(at).alias(label)

    return df.select(*fields(df.schema, "", ""))


def records(spark: SparkSession, rows: list[dict], nested: bool = False) -> DataFrame:
    """Rows of any keys, the union of all keys in order of appearance."""
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    names = list(dict.fromkeys(k for r in rows for k in r))
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    df = parsed(lines)
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df.select(*[f"`{n}`" for n in names])


@dataclass
class Connector:
    """A service with its configuration; ``fetch`` can be replaced in tests."""

    config: dict
    get: Fetch = http_json
    required: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        gone = [k for k in self.required if not self.config.get(k)]
        if gone:
            raise make("bad_config", f"missing {', '.join(gone)}")

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.config.get('access_token', '')}", "Accept": "application/json"}


class CrmQuery(Connector):
    """SELECT fields FROM object LIMIT n, names checked; no ``attributes``."""

    def query(self, obj: str, fields: list[str], limit: int) -> str:
        for name in (obj, *fields):
            if not IDENTIFIER.fullmatch(name):
                raise make("bad_config", f"not an identifier: {name!r}")
        return f"SELECT {', '.join(fields)} FROM {obj} LIMIT {int(limit)}"

    @staticmethod
    def rows(reply: dict) -> list[dict]:
        return [{k: v for k, v in r.items() if k != "attributes"} for r in reply.get("records", [])]

    def load(self, spark: SparkSession, object_type: str, fields: list[str], limit: int = 1000) -> DataFrame:
        q = urllib.parse.quote(self.query(object_type, fields, limit))
        return records(spark, self.rows(self.get(f"{self.config['instance_url']}/services/data/v57.0/query?q={q}", self.headers())))


class CrmObjects(Connector):
    """Objects of a type by pages of 100; columns are the union of their
    properties."""

    @staticmethod
    def rows(reply: dict) -> list[dict]:
        return [{"id": r.get("id"), **(r.get("properties") or {})} for r in reply.get("results", [])]

    def load(self, spark: SparkSession, object_type: str, properties: list[str] | None = None, limit: int = 1000) -> DataFrame:
        rows, after = [], None
        while len(rows) < limit:
            args = {"limit": min(100, limit - len(rows)), **({"properties": ",".join(properties)} if properties else {}), **({"after": after} if after else {})}
            reply = self.get(f"https://api.hubapi.com/crm/v3/objects/{urllib.parse.quote(object_type)}?{urllib.parse.urlencode(args)}", self.headers())
            rows += self.rows(reply)
            after = ((reply.get("paging") or {}).get("next") or {}).get("after")
            if not after or not reply.get("results"):
                break
        return records(spark, rows[:limit])


class Payments(Connector):
    """Nested objects flattened to ``a_b_c``, arrays dropped."""

    @classmethod
    def flat(cls, value: dict, prefix: str = "") -> dict:
        out: dict = {}
        for k, v in value.items():
            if isinstance(v, dict):
                out |= cls.flat(v, f"{prefix}{k}_")
            elif not isinstance(v, list):
                out[f"{prefix}{k}"] = v
        return out

    def load(self, spark: SparkSession, object_type: str, limit: int = 1000) -> DataFrame:
        rows, last = [], None
        while len(rows) < limit:
            args = {"limit": min(100, limit - len(rows)), **({"starting_after": last} if last else {})}
            reply = self.get(f"https://api.stripe.com/v1/{urllib.parse.quote(object_type)}?{urllib.parse.urlencode(args)}", self.headers())
            data = reply.get("data", [])
            rows += [self.flat(r) for r in data]
            if not reply.get("has_more") or not data:
                break
            last = data[-1].get("id")
        return records(spark, rows[:limit])


class Bases(Connector):
    """Records whose ``fields`` are the columns."""

    @staticmethod
    def rows(reply: dict) -> list[dict]:
        return [{"id": r.get("id"), "createdTime": r.get("createdTime"), **(r.get("fields") or {})} for r in reply.get("records", [])]

    def load(self, spark: SparkSession, limit: int = 1000) -> DataFrame:
        rows, offset = [], None
        while len(rows) < limit:
            args = {"pageSize": min(100, limit - len(rows)), **({"offset": offset} if offset else {})}
            reply = self.get(f"https://api.airtable.com/v0/{self.config['base_id']}/{urllib.parse.quote(self.config['table'])}?{urllib.parse.urlencode(args)}", self.headers())
            rows += self.rows(reply)
            offset = reply.get("offset")
            if not offset:
                break
        return records(spark, rows[:limit])


#: Connectors by name, with the options that they need.
REGISTRY: dict[str, tuple[type[Connector], tuple[str, ...]]] = {
    "crm_query": (CrmQuery, ("instance_url", "access_token")), "crm_objects": (CrmObjects, ("access_token",)), "payments": (Payments, ("access_token",)),
    "bases": (Bases, ("access_token", "base_id", "table")),
}


def connector(name: str, config: dict, get: Fetch = http_json) -> Connector:
    if name not in REGISTRY:
        raise make("integration_failed", f"unknown connector {name!r}")
    kind, required = REGISTRY[name]
    return kind(config, get, required)


def available() -> list[dict]:
    return [{"name": n, "required": list(r)} for n, (_, r) in REGISTRY.items()]


def load(spark: SparkSession, name: str, config: dict, get: Fetch = http_json, **options: object) -> DataFrame:
    """Options by name, those that the connector knows."""
    import inspect

    made = connector(name, config, get)
    known = inspect.signature(made.load).parameters  # type: ignore[attr-defined]
    return made.load(spark, **{k: v for k, v in options.items() if k in known})  # type: ignore[attr-defined]
