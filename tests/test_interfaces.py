"""HTTP, shell, streaming, the driver's queries."""

import io
import json
import threading
import urllib.request

import pytest

from quarry.database import Database
from quarry.server import Api, Limits, serve
from quarry.shell import Shell, complete, parse_command


@pytest.fixture
def api(spark):
    db = Database(spark)
    db.execute("CREATE TABLE songs (song INTEGER PRIMARY KEY, name TEXT NOT NULL, mood TEXT, sound VECTOR(2)); CREATE INDEX by_mood ON songs (mood)")
    return Api(db)


def post(api, path, **body):
    return api.handle("POST", path, json.dumps(body).encode())[:2]


def test_http(api):
    status, out = post(api, "/v1/sql", sql="INSERT INTO songs VALUES (11, 'Rain', 'calm', [0, 2]); SELECT name, sound FROM songs")
    assert status == 200 and [r["type"] for r in out["results"]] == ["command", "query"] and out["results"][0]["rows_affected"] == 1
    assert out["results"][1]["rows"] == [["Rain", [0.0, 2.0]]] and out["results"][1]["schema"] == [{"name": "name", "data_type": "TEXT"}, {"name": "sound", "data_type": "VECTOR(2)"}]
    songs = [{"song": 11, "name": "Rain II", "sound": [0, 8]}, {"Song": 12, "NAME": "Drums", "mood": "wild", "sound": [5, 0]}]
    status, out = post(api, "/v1/tables/songs/rows", rows=songs, normalize_vectors=True, on_conflict="do_update", conflict_target="song", update_columns=["name", "sound"])
    assert status == 200 and out["results"][0]["rows_affected"] == 2
    status, out = post(api, "/v1/vector/search", table="songs", vector_column="sound", query=[0, 1], metric="l2", select=["name", "mood"], filters=[{"column": "mood", "value": "calm"}, {"column": "song", "operator": "lt", "value": 100}])
    assert status == 200 and out["rows"] == [["Rain II", "calm", 0.0]] and out["rows_examined"] == 1 and out["columns"][-1] == "distance"
    assert post(api, "/v1/embeddings/search", table="songs", vector_column="sound", query=[1, 0], limit=1)[1]["rows"][0][:2] == [12, "Drums"]
    _, out = post(api, "/v1/sql/intent", sql="SELECT name FROM songs LIMIT 4")
    assert (out["operation"], out["columns"][0]["role"], out["limit"]) == ("select", "content", 4)
    assert api.handle("GET", "/readyz")[1]["status"] == "ready" and "quarry_tables 1" in api.handle("GET", "/metrics")[1]
    assert [t["row_count"] for t in api.handle("GET", "/v1/tables")[1]["tables"]] == [2] and api.handle("GET", "/v1/tables/songs/")[1]["indexes"] == [{"name": "by_mood", "column": "mood"}]


def test_http_statuses(api):
    rows = "/v1/tables/songs/rows"
    assert post(api, rows, rows=[{"song": 1, "name": "a", "sound": [1]}]) == (400, {"error": {"code": "dimension_mismatch", "message": "vector dimensions differ: left has 2, right has 1"}})
    assert [post(api, "/v1/sql", sql=s)[0] for s in ("SELECT 1 FROM albums", "SELECT lower(name) FROM songs", "SELECT song FROM songs WHERE name", "CREATE TABLE songs (n INT)")] == [404, 501, 400, 409]
    assert post(api, rows, rows=[{"song": 1, "colour": "x"}])[0] == 404 and post(api, rows, rows=[{"song": 1}])[0] == 409
    assert post(api, rows, on_conflict="do_update", update_columns=["name"], rows=[{"song": 1, "name": "x"}])[0] == 400
    assert api.handle("POST", "/v1/sql", b"{not json")[0] == api.handle("POST", "/v1/sql", b"[1]")[0] == 400 and api.handle("DELETE", "/v1/tables/songs")[0] == 404
    few = Api(api.db, limits=Limits(max_bulk_rows=1, max_response_rows=1, max_json_payload_bytes=200))
    assert post(few, rows, rows=[{}, {}])[0] == post(few, "/v1/sql", sql="x" * 300)[0] == 413
    few.db.insert_rows("songs", [(1, "a", None, None), (2, "b", None, None)])
    assert post(few, "/v1/sql", sql="SELECT song FROM songs")[0] == 422


@pytest.mark.parametrize("wrong", [
    {"query": 3}, {"query": [1, "x"]}, {"query": [1, None]}, {"limit": "x"}, {"limit": 0}, {"limit": True}, {"limit": 2.5}, {"metric": 7}, {"metric": "cubic"}, {"select": "name"}, {"select": [1]}, {"table": 1}, {"vector_column": "name"},
    {"filters": {"column": "name"}}, {"filters": ["name"]}, {"filters": [{"operator": "eq"}]}, {"filters": [{"column": 1}]}, {"filters": [{"column": "song", "operator": []}]}, {"filters": [{"column": "song", "value": [1]}]}, {"filters": [{"column": "song", "operator": "lt"}]},
])
def test_wrong_search_arguments_are_answered(api, wrong):
    status, out = post(api, "/v1/vector/search", **({"table": "songs", "vector_column": "sound", "query": [1, 0]} | wrong))
    assert status == 400 and out["error"]["code"] == "invalid_request", out


def test_other_wrong_arguments_are_answered(api, monkeypatch):
    rows = "/v1/tables/songs/rows"
    for body in ({"rows": 3}, {"rows": ["x"]}, {"rows": [], "on_conflict": 1}, {"rows": [], "update_columns": "name"}, {"rows": [], "update_columns": [2]}, {"rows": [], "normalize_vectors": "yes"}, {"rows": [{"song": "x", "name": "y"}]}, {"rows": [{"song": 1, "name": "y", "sound": "z"}]}):
        assert post(api, rows, **body)[0] == 400, body
    assert post(api, "/v1/sql")[0] == post(api, "/v1/sql", sql=["SELECT 1"])[0] == post(api, "/v1/sql/intent", sql=1)[0] == 400
    monkeypatch.setattr(api, "route", lambda *_: 1 / 0)
    assert api.handle("GET", "/v1/tables")[:2] == (500, {"error": {"code": "internal_error", "message": "ZeroDivisionError"}})


def test_http_admission(api):
    closed = Api(api.db, token="schlüssel", limits=Limits(max_tasks=1))
    status = lambda value: closed.handle("GET", "/v1/tables", headers={"authorization": value} if value else None)[0]
    assert [status(x) for x in (None, "Bearer x", "Bearer é\udcff", "Bearer schlüssel")] == [401, 401, 401, 200] and closed.handle("GET", "/healthz")[0] == 200
    closed.slots.acquire()
    code, _, headers = closed.handle("GET", "/v1/tables", headers={"Authorization": "Bearer schlüssel"})
    assert code == 503 and headers["Retry-After"] and closed.rejected == 1


def test_http_over_a_socket(api):
    server = serve(api, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/healthz") as r:
        assert json.load(r)["status"] == "ok"
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/") as r:
        assert r.headers["Content-Type"].startswith("text/html") and b"/v1/sql" in r.read()
    server.shutdown()


def test_parsed_texts_are_remembered_within_bounds():
    from quarry.plans.syntax import Remembered

    parse = Remembered(texts=3, each=40, total=60)
    first = parse("SELECT 1")
    assert parse("SELECT 1") is first and parse("SELECT " + "1" * 18 + " " * 40) is not parse("SELECT " + "1" * 18 + " " * 40)
    for i in range(9):
        parse(f"SELECT {i} + 100000000")
    assert len(parse.held) <= 3 and parse.size == sum(map(len, parse.held)) <= 60 and parse("SELECT 1") is not first


def test_shell(spark, tmp_path):
    out = io.StringIO()
    s = Shell(Database(spark), out)
    (tmp_path / "more.sql").write_text("INSERT INTO q VALUES (8, NULL);")
    for line in ("CREATE TABLE q (n INT,", " e VECTOR(3));", "INSERT INTO q VALUES (6, [3, 4, 5]);", f".read {tmp_path}/more.sql", "SELECT * FROM q;", ".tables", ".schema q", ".nonsense", "SELECT colour FROM q;", ".timer on", ".quit"):
        s.feed(line)
    text = out.getvalue()
    assert "[3, 4, 5]" in text and "NULL" in text and "(2 rows)" in text and "unknown command" in text and "does not exist" in text and s.done
    assert parse_command("DELETE FROM q") is None and complete("SELECT '--;';") and not complete("SELECT \"a;")


def test_streaming_upserts(spark, tmp_path):
    from quarry.streaming.ingest import upsert_stream

    db = Database(spark)
    db.execute("CREATE TABLE readings (meter INTEGER PRIMARY KEY, value DOUBLE)")
    for i in range(2):
        spark.createDataFrame([(k, float(i * 100 + k)) for k in range(5, 8 + i)], "meter long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("meter long, value double").parquet(str(tmp_path / "in"))
        q = upsert_stream(db, "readings", stream, "meter", ["value"], str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination(60)
    assert db.query("SELECT * FROM readings ORDER BY meter").rows == [(5, 105.0), (6, 106.0), (7, 107.0), (8, 108.0)]


def test_driver_queries(spark, sf):
    import duckdb

    import __spark_entry__ as entry
    from quarry import queries as engine

    con = duckdb.connect()
    for t in engine.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert entry.entry(spark).count() > 0
    text = lambda r: sorted(str(tuple(x)) for x in r)
    sql = engine.oracle_sql()
    for name, query in engine.queries().items():
        df = query(spark, sf)
        cols = sorted(df.columns)
        got = df.select(*cols).collect()
        if name in sql:
            want = con.sql(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
            assert text(got) == text(want), name
