"""The REST source and sink against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from sluicework.sources.readers import read_rest
from sluicework.sources.rest import Client, extract_records, schema_ddl
from sluicework.sources.writers import write_rest


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        seen, refuse = [], 0

        def reply(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            Handler.seen.append((self.path, dict(self.headers)))
            if Handler.refuse:
                Handler.refuse -= 1
                return self.reply(429, {})
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if self.path.startswith("/cursor"):
                at = int(q.get("cursor", 0))
                return self.reply(200, {"data": [{"id": at}], "next_cursor": str(at + 1) if at < 2 else None})
            if self.path.startswith("/next"):
                at = int(q.get("p", 0))
                return self.reply(200, {"data": [{"id": at}], "next": f"http://127.0.0.1:{self.server.server_port}/next?p={at + 1}" if at < 2 else None})
            at = int(q.get("offset", 0))
            self.reply(200, {"data": [{"id": i, "at": "2024-01-02T03:04:05"} for i in range(at, min(at + 2, 5))]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.seen.append(("POST", body))
            self.reply(400 if any(r["id"] == 3 for r in body["records"]) else 200, {})

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.handler = Handler
    yield s
    s.shutdown()


def url(server, path=""):
    return f"http://127.0.0.1:{server.server_port}/{path}"


@pytest.mark.parametrize("path,paging", [("", {"type": "offset", "page_size": 2}), ("", {"type": "offset", "page_size": 2, "max_pages": 9}), ("cursor", {"type": "cursor"}), ("next", {"type": "next_link"})])
def test_pages(spark, server, path, paging):
    df = read_rest(spark, {"url": url(server, path), "root_key": "data", "pagination": paging, "schema": "id int"})
    assert sorted(r["id"] for r in df.collect()) == (list(range(5)) if not path else [0, 1, 2])


def test_types_auth_and_retries(spark, server):
    server.handler.refuse = 1
    cfg = {"url": url(server), "root_key": "data", "auth": {"type": "bearer", "token": "s"}, "retry": {"backoff": 0.01}}
    rows = [r for p in Client(cfg).pages() for r in p]
    assert len(rows) == 2 and server.handler.seen[-1][1]["Authorization"] == "Bearer s" and len(server.handler.seen) == 2
    server.handler.refuse = 1
    with pytest.raises(Exception):
        list(Client({**cfg, "retry": {"max_retries": 0}}).pages())
    df = read_rest(spark, {"url": url(server), "root_key": "data", "schema": [{"name": "id", "type": "long"}, {"name": "at", "type": "timestamp"}]})
    assert df.first()["at"].year == 2024
    with pytest.raises(ValueError):
        read_rest(spark, {"url": url(server), "pagination": {"type": "spiral"}})
    with pytest.raises(ValueError):
        Client({"auth": {"type": "magic"}})


def test_records():
    assert extract_records([1]) == [1] and extract_records({"a": 1}) == [{"a": 1}] and extract_records({"d": [1]}, "d") == [1]
    for body, key in (({"a": 1}, "d"), ({"d": 1}, "d"), (3, None)):
        with pytest.raises(ValueError):
            extract_records(body, key)
    assert schema_ddl([{"name": "a", "type": "str"}]) == "`a` string"


def test_write_counts_failures(spark, server):
    df = spark.range(5).coalesce(1)
    with pytest.raises(RuntimeError, match="1 batches"):
        write_rest(df, {"url": url(server), "batch_size": 2})
    assert sum(len(b["records"]) for k, b in server.handler.seen if k == "POST") == 5
