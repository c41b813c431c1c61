"""REST as a Spark data source: pages are fetched where the partitions run.

Page numbers known ahead (offset paging with ``max_pages``) become partitions of their own;
cursors and next links are walked by one. Records travel as JSON text and are parsed by
``from_json`` under the declared schema, so any Spark type can be declared.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import shared_folder

PAGINATIONS = ("none", "offset", "cursor", "next_link")
RETRIED = (429, 503)
# Names of simple types that a declared schema may use.
TYPE_NAMES = {"str": "string", "int": "int", "integer": "int", "long": "bigint", "bool": "boolean"}


def schema_ddl(schema: str | list[Mapping[str, str]] | None) -> str | None:
    """A DDL text, or a list of {name, type} with any DDL type."""
    if not schema or isinstance(schema, str):
        return schema or None
    ddl = ", ".join(f"`{f['name']}` {TYPE_NAMES.get(f.get('type', 'string').lower(), f.get('type', 'string'))}" for f in schema)
    T._parse_datatype_string(ddl) if SparkSession.getActiveSession() else None
    return ddl


def extract_records(body: Any, root_key: str | None = None) -> list[dict]:
    """The records of a response: the list under ``root_key``, a list as it is, or one object."""
    if root_key:
        if not isinstance(body, dict) or root_key not in body:
            raise ValueError(f"the response has no {root_key!r}")
        if not isinstance(body[root_key], list):
            raise ValueError(f"{root_key!r} does not hold a list")
        return body[root_key]
    if isinstance(body, list):
        return body
    if isinstance(body, dict):
        return [body]
    raise ValueError(f"a response of type {type(body).__name__} has no records")


class Client:
    """Requests with authentication, a rate limit and retries. Made where it is used."""

    def __init__(self, cfg: Mapping[str, Any]):
        import requests

        self.cfg, self._session, self._sleep = cfg, requests.Session(), time.sleep
        self._session.headers.update(cfg.get("headers") or {})
        self.params: dict[str, Any] = dict(cfg.get("params") or {})
        auth = cfg.get("auth") or {}
        kind = auth.get("type")
        if kind == "bearer":
            self._session.headers["Authorization"] = f"Bearer {auth['token']}"
        elif kind == "api_key_header":
            self._session.headers[auth.get("header", "X-Api-Key")] = auth["key"]
        elif kind == "api_key_query":
            self._session.params = {auth.get("param", "api_key"): auth["key"]}
        elif kind == "basic":
            self._session.auth = (auth["username"], auth["password"])
        elif kind:
            raise ValueError(f"unknown auth type {kind!r}")

    def send(self, url: str, params: Mapping[str, Any] | None, body: Any = None, method: str | None = None, retried: tuple[int, ...] = RETRIED, headers: Mapping[str, str] | None = None) -> Any:
        """Retries are set under ``retry`` (max_retries, statuses, backoff) or, as max_retries and
        retry_on, under ``rate_limit``."""
        limits = self.cfg.get("rate_limit") or {}
        retry = {"max_retries": limits.get("max_retries"), "statuses": limits.get("retry_on")} | (self.cfg.get("retry") or {})
        tries = 1 + int(3 if retry.get("max_retries") is None else retry["max_retries"])
        for attempt in range(tries):
            if limits.get("requests_per_second"):
                self._sleep(1.0 / float(limits["requests_per_second"]))
            reply = self._session.request(method or self.cfg.get("method", "GET"), url, params=params, json=body, headers=headers, timeout=float(self.cfg.get("timeout", 30)))
            if reply.status_code not in tuple(retry.get("statuses") or retried) or attempt == tries - 1:
                reply.raise_for_status()
                return reply
            self._sleep(float(retry.get("backoff", 1.0)) * 2**attempt)

    def pages(self, first_page: int = 0, pages: int | None = None) -> Iterator[list[dict]]:
        cfg = self.cfg
        paging = cfg.get("pagination") or {}
        kind, root = paging.get("type", "none"), cfg.get("root_key")
        url, params, body = cfg["url"], dict(self.params), cfg.get("body")
        most = pages if pages is not None else paging.get("max_pages")
        if kind == "offset":
            size = int(paging.get("page_size", 100))
            if paging.get("limit_param"):
                params[paging["limit_param"]] = size
            n, where = first_page, paging.get("offset_param", "offset")
            begin = int(params.get(where) or 0)
            while most is None or n < first_page + int(most):
                params[where] = begin + n * size
                records = extract_records(self.send(url, params, body).json(), root)
                if not records:
                    return
                yield records
                n += 1
            return
        seen = 0
        while url and (most is None or seen < int(most)):
            reply = self.send(url, params, body).json()
            yield extract_records(reply, root)
            seen += 1
            if kind == "cursor":
                cursor = reply.get(paging.get("cursor_response_key", "next_cursor")) if isinstance(reply, dict) else None
                if not cursor:
                    return
                params[paging.get("cursor_param", "cursor")] = cursor
            elif kind == "next_link":
                url, params = (reply.get(paging.get("next_key", "next")) if isinstance(reply, dict) else None), None
            else:
                return


class _Page(InputPartition):
    def __init__(self, first: int, count: int | None):
        self.first, self.count = first, count


class RestReader(DataSourceReader):
    def __init__(self, cfg: dict):
        self.cfg = cfg

    def partitions(self) -> list[InputPartition]:
        paging = self.cfg.get("pagination") or {}
        if paging.get("type") == "offset" and paging.get("max_pages"):
            pages, parts = int(paging["max_pages"]), int(self.cfg.get("num_partitions", 4))
            step = -(-pages // min(parts, pages))
            return [_Page(a, min(step, pages - a)) for a in range(0, pages, step)]
        return [_Page(0, None)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for records in Client(self.cfg).pages(partition.first, partition.count):
            for record in records:
                yield (json.dumps(record),)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sluice_rest"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(json.loads(self.options["config"]))


def read_rest(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """The records of a REST resource. Without a declared schema they are fetched once into the shared
    folder and their schema is inferred; no records and no schema is an error."""
    if not cfg.get("url"):
        raise ValueError("a rest_api input needs url")
    kind = (cfg.get("pagination") or {}).get("type", "none")
    if kind not in PAGINATIONS:
        raise ValueError(f"unknown pagination {kind!r}; known: {', '.join(PAGINATIONS)}")
    plain = {k: v for k, v in cfg.items() if k not in ("format", "schema")}
    spark.dataSource.register(RestSource)
    records = spark.read.format("sluice_rest").option("config", json.dumps(plain)).load()
    ddl = schema_ddl(cfg.get("schema"))
    if ddl is None:
        path = shared_folder(spark, "rest-records")
        records.write.text(path)
        found = spark.read.json(path)
        if not found.schema.fields:
            raise ValueError("no records came and no schema is declared")
        return found
    return records.select(F.from_json("record", ddl).alias("r")).select("r.*")
