"""HTTP API on the standard library's server: SQL, intent, typed ingestion, vector search, metadata, health."""

from __future__ import annotations

import argparse
import hmac
import json
import os
import threading
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from quarry import errors as E
from quarry.database import Command, Database, QueryResult

VERSION = "0.1.0"


@dataclass(frozen=True)
class Limits:
    max_json_payload_bytes: int = 32 << 20
    max_bulk_rows: int = 10_000
    max_response_rows: int = 10_000
    max_tasks: int = 32


class Page(str):
    """A text that is HTML."""


class HttpError(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


def result_to_json(r: QueryResult | Command) -> dict:
    if isinstance(r, Command):
        return {"type": "command", "tag": r.tag, "rows_affected": r.rows_affected}
    return {
        "type": "query", "columns": r.columns, "schema": [{"name": n, "data_type": str(t) if t else None} for n, t in zip(r.columns, r.types)],
        "rows": [list(x) for x in r.rows], "row_count": len(r.rows), "rows_examined": r.rows_examined,
    }


class Api:
    """Requests to answers, apart from sockets."""

    def __init__(self, db: Database, token: str | None = None, limits: Limits = Limits()):
        self.db, self.token, self.limits = db, token, limits
        self.slots = threading.BoundedSemaphore(limits.max_tasks)
        self.in_flight = self.rejected = 0

    def handle(self, method: str, path: str, body: bytes = b"", headers: dict | None = None) -> tuple[int, object, dict]:
        """(status, JSON value or text, headers)."""
        try:
            return 200, self.route(method, path.split("?")[0].rstrip("/") or "/", body, {k.lower(): v for k, v in (headers or {}).items()}), {}
        except HttpError as e:
            extra = {"Retry-After": "1"} if e.status == 503 else {"WWW-Authenticate": "Bearer"} if e.status == 401 else {}
            return e.status, {"error": {"code": e.code, "message": str(e)}}, extra
        except E.QuarryError as e:
            status, code = E.http_status(e)
            return status, {"error": {"code": code, "message": str(e)}}, {}
        except Exception as e:  # noqa: BLE001  a request never ends without an answer
            return 500, {"error": {"code": "internal_error", "message": type(e).__name__}}, {}

    def route(self, method: str, path: str, body: bytes, headers: dict):
        if (method, path) == ("GET", "/"):
            return Page((Path(__file__).parent / "console.html").read_text())
        if (method, path) == ("GET", "/healthz"):
            return {"status": "ok", "version": VERSION, "storage": "persistent" if self.db.store else "memory", **asdict(self.limits)}
        if (method, path) == ("GET", "/readyz"):
            return {"status": "ready", "revision": self.db.revision, "database_tasks_in_flight": self.in_flight, **asdict(self.limits)}
        if (method, path) == ("GET", "/metrics"):
            return self.metrics()
        if self.token and not hmac.compare_digest(headers.get("authorization", "").encode("utf-8", "surrogateescape"), f"Bearer {self.token}".encode()):
            raise HttpError(401, "unauthorized", "a valid bearer token is required")
        if len(body) > self.limits.max_json_payload_bytes:
            raise HttpError(413, "payload_too_large", f"the payload is over {self.limits.max_json_payload_bytes} bytes")
        if not self.slots.acquire(blocking=False):
            self.rejected += 1
            raise HttpError(503, "overloaded", "all database tasks are in use")
        self.in_flight += 1
        try:
            return self.work(method, path, body)
        finally:
            self.in_flight -= 1
            self.slots.release()

    def field(self, req: dict, name: str, kind: type, *default):
        """A field of a request, of the kind that it must have; without a default it must be there."""
        value = req.get(name)
        if value is None:
            if default:
                return default[0]
            raise HttpError(400, "invalid_request", f"missing field {name}")
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            raise HttpError(400, "invalid_request", f"{name} must be of type {kind.__name__}")
        return value

    def work(self, method: str, path: str, body: bytes):
        parts = path.strip("/").split("/")
        if method == "GET" and parts[:2] == ["v1", "tables"] and len(parts) in (2, 3):
            return {"tables": [self.table(t) for t in self.db.list_tables()]} if len(parts) == 2 else self.table(parts[2])
        if method != "POST":
            raise HttpError(404, "not_found", f"no route {method} {path}")
        try:
            req = json.loads(body or b"{}")
        except ValueError as e:
            raise HttpError(400, "invalid_json", str(e)) from e
        if not isinstance(req, dict):
            raise HttpError(400, "invalid_json", "expected an object")
        if path == "/v1/sql":
            results = self.db.execute(self.field(req, "sql", str), self.limits.max_response_rows)
            return {"results": [result_to_json(r) for r in results]}
        if path == "/v1/sql/intent":
            return {"operation": "select"} | asdict(self.db.query_intent(self.field(req, "sql", str)))
        if path in ("/v1/vector/search", "/v1/embeddings/search"):
            table, column, query = (self.field(req, n, k) for n, k in (("table", str), ("vector_column", str), ("query", list)))
            metric, limit = self.field(req, "metric", str, "cosine"), self.field(req, "limit", int, 10)
            select, filters = self.field(req, "select", list, None), self.field(req, "filters", list, None)
            if not all(isinstance(x, str) for x in select or []):
                raise HttpError(400, "invalid_request", "select must be a list of names")
            return result_to_json(self.db.search(table, column, query, metric, select, filters, limit))
        if parts[:2] == ["v1", "tables"] and len(parts) == 4 and parts[3] == "rows":
            rows = req.get("rows")
            if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                raise HttpError(400, "invalid_request", "rows must be a list of objects")
            if len(rows) > self.limits.max_bulk_rows:
                raise HttpError(413, "too_many_rows", f"at most {self.limits.max_bulk_rows} rows")
            # fixed values: names of the request's fields
            unit_length = self.field(req, "normalize_vectors", bool, False)
            update = self.field(req, "update_columns", list, None)
            if not all(isinstance(x, str) for x in update or []):
                raise HttpError(400, "invalid_request", "update_columns must be a list of names")
            n = self.db.ingest_json(parts[2], rows, unit_length, self.field(req, "on_conflict", str, "fail"), self.field(req, "conflict_target", str, None), update)
            return {"results": [{"type": "command", "tag": "INSERT", "rows_affected": n}]}
        raise HttpError(404, "not_found", f"no route {method} {path}")

    def table(self, name: str) -> dict:
        i = self.db.table_info(name)
        return {
            "name": name, "row_count": i["rows"], "columns": [{"name": c.name, "data_type": str(c.type), "nullable": c.nullable, "unique": c.unique} for c in i["columns"]],
            "indexes": [{"name": n, "column": c} for n, c in i["indexes"]],
        }

    def metrics(self) -> str:
        values = {"up": 1, "catalog_revision": self.db.revision, "tables": len(self.db.tables), "database_tasks_in_flight": self.in_flight, "database_tasks_rejected_total": self.rejected, "http_max_json_payload_bytes": self.limits.max_json_payload_bytes}
        return "".join(f"quarry_{k} {v}\n" for k, v in values.items())


def serve(api: Api, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to run; serve_forever() runs it, shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            given = self.headers.get("Content-Length") or "0"
            n = int(given) if given.isascii() and given.isdigit() else 0
            body = self.rfile.read(min(n, api.limits.max_json_payload_bytes + 1))
            status, value, extra = api.handle(self.command, self.path, body, dict(self.headers))
            text = value if isinstance(value, str) else json.dumps(value)
            raw = text.encode()
            self.send_response(status)
            kind = "text/html; charset=utf-8" if isinstance(value, Page) else "text/plain; version=0.0.4" if isinstance(value, str) else "application/json"
            for k, v in {"Content-Type": kind, "Content-Length": str(len(raw)), **extra}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    from pyspark.sql import SparkSession

    env = os.environ.get
    a = argparse.ArgumentParser(description="HTTP server")
    a.add_argument("--host", default=env("QUARRY_HOST", "127.0.0.1"))
    a.add_argument("--port", type=int, default=int(env("QUARRY_PORT", "8080")))
    a.add_argument("--data-dir", default=env("QUARRY_DATA_DIR"))
    a.add_argument("--snapshot", default=env("QUARRY_SNAPSHOT"))
    a.add_argument("--autosave-seconds", type=float, default=float(env("QUARRY_AUTOSAVE_SECONDS", "30")))
    a.add_argument("--shutdown-file", default=env("QUARRY_SHUTDOWN_FILE"), help="the server ends, saving, when this file appears")
    o = a.parse_args()
    spark = SparkSession.builder.appName("quarry-server").getOrCreate()
    if o.data_dir:
        db = Database.open_persistent(spark, o.data_dir)
    else:
        db = Database.open(spark, o.snapshot) if o.snapshot and Path(o.snapshot).exists() else Database(spark)
    server, stop = serve(Api(db, env("QUARRY_TOKEN")), o.host, o.port), threading.Event()

    def watch():
        left = o.autosave_seconds
        while not stop.wait(0.5):
            left -= 0.5
            if left <= 0 and o.snapshot and not o.data_dir:
                db.save_if_changed(o.snapshot)
                left = o.autosave_seconds
            if o.shutdown_file and Path(o.shutdown_file).exists():
                server.shutdown()
                return

    threading.Thread(target=watch, daemon=True).start()
    try:
        server.serve_forever()
    finally:
        stop.set()
        if o.snapshot and not o.data_dir:
            db.save_if_changed(o.snapshot)
        db.close()


if __name__ == "__main__":
    main()
