"""SQL semantics, constraints, plans, intent."""

import math

import numpy as np
import pytest

from quarry import errors as E
from quarry.database import Database
from quarry.types import type_of

PARCELS = """CREATE TABLE parcels (id BIGINT PRIMARY KEY, label TEXT NOT NULL, depot TEXT, kilos DOUBLE, sent BOOLEAN, place VECTOR(3));
INSERT INTO parcels VALUES (10, 'Blue kettle', 'north', 3.5, TRUE, ARRAY[2, 0, 0]), (20, 'green lamp', 'south', 1.25, TRUE, ARRAY[0, 3, 4]),
(30, 'blue chair', 'north', 12, FALSE, ARRAY[1, 1, 0]), (40, 'Mirror', NULL, NULL, FALSE, ARRAY[0, 0, 5]),
(50, 'Red rug', 'east', 7.75, NULL, ARRAY[-1, 0, 0]), (60, 'blueprint tube', 'south', 0.5, TRUE, NULL)"""


@pytest.fixture(scope="module")
def shared(spark):
    out = Database(spark)
    out.execute(PARCELS)
    return out


@pytest.fixture
def db(shared):
    """The same rows for every test: versions are immutable, so a copy of the catalog is enough."""
    return shared._copy()


def rows(db, sql):
    return db.query(sql).rows


def test_ranking_with_filters(db):
    got = rows(db, "SELECT label, place <=> [5, 0, 0] AS far FROM parcels WHERE depot = 'north' AND kilos >= 3 ORDER BY far LIMIT 5")
    assert [r[0] for r in got] == ["Blue kettle", "blue chair"] and got[0][1] == 0.0 and got[1][1] == pytest.approx(1 - math.sqrt(0.5), abs=1e-7)
    assert rows(db, "SELECT id FROM parcels WHERE (label ILIKE 'BLUE%' OR depot IN ('east', 'west')) AND id NOT BETWEEN 40 AND 45 ORDER BY id DESC LIMIT 3 OFFSET 1") == [(50,), (30,), (10,)]


def test_null_embeddings_and_ties_are_ranked(db):
    near = "SELECT id FROM parcels ORDER BY l2_distance(place, [0, 0, 0])"
    assert [r[0] for r in rows(db, near + " LIMIT 9")] == [50, 30, 10, 20, 40, 60]
    assert [r[0] for r in rows(db, near + " DESC LIMIT 4")] == [60, 20, 40, 10]
    assert [r[0] for r in rows(db, near + " NULLS FIRST LIMIT 2 OFFSET 1")] == [50, 30]
    assert rows(db, "SELECT place IS NULL, vector_dims(place), place = place FROM parcels WHERE id = 60") == [(True, None, None)]


def test_vector_functions(db):
    got = rows(db, "SELECT normalize(VECTOR(0, -6, 8)), norm([5, 12]), vector_dims(ARRAY[7, 7, 7, 7]), euclidean_distance([1, 1], [4, 5]), [2, 3] <#> [10, -1], squared_l2_distance([1, 2], [3, 5]), inner_product([1, 2, 3], [4, 5, 6])")[0]
    assert got[0] == pytest.approx([0, -0.6, 0.8]) and got[1:] == (13.0, 4, 5.0, -17.0, 13.0, 32.0)
    assert rows(db, "SELECT place <=> NULL, dot_product(NULL, place) FROM parcels WHERE id = 10") == [(None, None)]


def test_arithmetic(db):
    assert rows(db, "SELECT 17/5, -17/5, -17%5, 17.0/4, 2+3*4-1, (2+3)*4, -(-6), 17.5 % 5") == [(3, -3, -2, 4.25, 13, 20, 6, 2.5)]
    assert rows(db, "SELECT id/7, -id/7, -id%7, kilos*2 FROM parcels WHERE id = 50") == [(7, -7, -1, 15.5)]
    for bad in ("SELECT 5 % 0", "SELECT kilos/0 FROM parcels", "SELECT 2.0 % 0", "SELECT -9223372036854775807 - 2", "SELECT id * 9223372036854775807 FROM parcels", "SELECT 9e307 + 9e307", "SELECT kilos * 1e308 * 1e10 FROM parcels"):
        with pytest.raises(E.InvalidQuery):
            rows(db, bad)


def test_aggregates(db):
    got = rows(db, "SELECT COUNT(*), COUNT(kilos), COUNT(DISTINCT depot), SUM(id), AVG(kilos), MIN(label), MAX(label), SUM(DISTINCT id / 30) FROM parcels")[0]
    assert got == (6, 5, 3, 210, 5.0, "Blue kettle", "green lamp", 3)
    assert rows(db, "SELECT depot, COUNT(*) AS n, AVG(kilos) FROM parcels GROUP BY depot ORDER BY n DESC, depot") == [("north", 2, 7.75), ("south", 2, 0.875), ("east", 1, 7.75), (None, 1, None)]
    assert rows(db, "SELECT depot, MAX(id) FROM parcels GROUP BY (depot)") == [("north", 30), ("south", 60), (None, 40), ("east", 50)]
    assert rows(db, "SELECT id % 20, COUNT(*) FROM parcels GROUP BY id % 20 HAVING MIN(kilos) < 1 OR COUNT(sent) = 2") == [(10, 3), (0, 3)]
    assert rows(db, "SELECT COUNT(*), SUM(kilos), AVG(id), MIN(depot), MAX(sent) FROM parcels WHERE id > 1000") == [(0, None, None, None, None)]
    assert rows(db, "SELECT COUNT(*), 1 + COUNT(7)") == [(1, 2)]
    for bad in ("SELECT label, MAX(id) FROM parcels", "SELECT id FROM parcels WHERE MAX(id) > 1", "SELECT AVG(SUM(id)) FROM parcels", "SELECT id FROM parcels HAVING kilos > 1", "SELECT SUM(*) FROM parcels", "SELECT COUNT(*) FROM parcels GROUP BY COUNT(*)"):
        with pytest.raises(E.InvalidQuery):
            rows(db, bad)


def test_order_of_nulls_and_distinct_rows(db):
    assert [r[0] for r in rows(db, "SELECT kilos FROM parcels ORDER BY kilos")] == [0.5, 1.25, 3.5, 7.75, 12.0, None]
    assert [r[0] for r in rows(db, "SELECT kilos FROM parcels ORDER BY kilos DESC LIMIT 3")] == [None, 12.0, 7.75]
    assert [r[0] for r in rows(db, "SELECT depot FROM parcels ORDER BY depot NULLS FIRST, kilos DESC NULLS LAST")] == [None, "east", "north", "north", "south", "south"]
    assert rows(db, "SELECT DISTINCT sent FROM parcels ORDER BY id DESC") == [(None,), (False,), (True,)]
    assert rows(db, "SELECT DISTINCT depot, sent FROM parcels LIMIT 2 OFFSET 1") == [("south", True), ("north", False)]
    assert rows(db, "SELECT id FROM parcels WHERE NULL OR FALSE") == [] and rows(db, "SELECT id FROM parcels ORDER BY 'x' LIMIT 2") == [(10,), (20,)]


def test_three_valued_logic(db):
    got = rows(db, "SELECT sent AND kilos > 1, sent OR kilos > 1, NOT sent, depot NOT IN ('north', NULL), sent IS NOT TRUE, kilos BETWEEN NULL AND 1 FROM parcels WHERE id >= 40 ORDER BY id")
    assert got == [(False, None, True, None, True, None), (None, True, None, None, True, False), (False, True, False, None, False, None)]


def test_like_has_no_escape(db):
    assert rows(db, r"SELECT 'c:\x' LIKE 'c:\x', 'per_cent' LIKE 'per\_cent', 'per-cent' LIKE 'per_cent', 'ÖL' ILIKE 'ö_', '100%' NOT LIKE '1%0'") == [(True, False, True, True, True)]


WRONG = {
    E.TypeMismatch: [
        "SELECT label = 3 FROM parcels", "SELECT id FROM parcels WHERE depot", "SELECT CAST(label AS DOUBLE) FROM parcels", "SELECT CAST(2.5 AS BIGINT)", "SELECT id FROM parcels ORDER BY place", "SELECT [1, NULL]",
        "INSERT INTO parcels (id, label) VALUES ('x', 'y')", "SELECT -label FROM parcels", "SELECT MIN(place) FROM parcels", "UPDATE parcels SET kilos = 'heavy'", "SELECT place < place FROM parcels",
    ],
    E.ColumnNotFound: ["SELECT colour FROM parcels", "UPDATE parcels SET colour = 1", "INSERT INTO parcels (id, colour) VALUES (1, 2)", "CREATE INDEX i ON parcels (colour)"],
    E.TableNotFound: ["SELECT 1 FROM letters", "DELETE FROM letters", "DROP TABLE letters"],
    E.DimensionMismatch: ["SELECT place <-> [1, 2] FROM parcels", "INSERT INTO parcels (id, label, place) VALUES (1, 'x', [1, 2, 3, 4])", "UPDATE parcels SET place = [1]"],
    E.Unsupported: [
        "SELECT upper(label) FROM parcels", "SELECT label || 'x' FROM parcels", "SELECT 1 FROM parcels JOIN parcels p ON TRUE", "SELECT 1 UNION ALL SELECT 2", "WITH p AS (SELECT 1) SELECT 1", "SELECT SUM(id) OVER () FROM parcels",
        "SELECT CASE WHEN sent THEN 1 END FROM parcels", "EXPLAIN ANALYZE SELECT id FROM parcels", "SELECT DISTINCT ON (depot) id FROM parcels", "CREATE TABLE t AS SELECT 1", "CREATE TABLE t (d TIMESTAMP)", "CREATE TABLE t (n INT DEFAULT 3)",
        "CREATE INDEX i ON parcels (place)", "INSERT INTO parcels (id, label) SELECT 1, 'x'",
    ],
    E.DuplicateColumn: ["CREATE TABLE t (n INT, N TEXT)", "UPDATE parcels SET kilos = 1, KILOS = 2", "INSERT INTO parcels (id, id) VALUES (1, 2)"],
    E.TableAlreadyExists: ["CREATE TABLE parcels (n INT)"],
    E.IndexNotFound: ["DROP INDEX by_depot"],
    E.InvalidVectorDimension: ["CREATE TABLE t (v VECTOR(0))"],
    E.VectorDimensionLimit: ["CREATE TABLE t (v VECTOR(65536))"],
    E.NullViolation: ["INSERT INTO parcels (id) VALUES (99)", "UPDATE parcels SET label = NULL WHERE id = 20"],
    E.UniqueViolation: ["INSERT INTO parcels (id, label) VALUES (20, 'again')", "UPDATE parcels SET id = 7"],
    E.InvalidQuery: ["SELECT id FROM parcels LIMIT -2", "SELECT id FROM parcels LIMIT 1.5", "SELECT id FROM parcels OFFSET NULL", "INSERT INTO parcels (id, label) VALUES (1, 'x') ON CONFLICT (label) DO NOTHING", "SELECT 123456789012345678901", "CREATE TABLE t (_rowid INT)"],
    E.ParseError: ["SELEKT 1", "SELECT (1", "SELECT 'open"],
    E.ZeroNorm: ["SELECT place <=> [0, 0, 0] FROM parcels", "SELECT normalize([0, 0])"],
}


@pytest.mark.parametrize("kind", WRONG, ids=lambda k: k.__name__)
def test_errors(db, kind):
    revision = db.revision
    for sql in WRONG[kind]:
        with pytest.raises(kind):
            [getattr(r, "rows", None) for r in db.execute(sql)]
        assert db.revision == revision, sql


def test_labels_and_values(db):
    r = db.query("SELECT id, kilos * 2, COUNT(*) AS n, [1, 2] FROM parcels WHERE id = 10 GROUP BY id, kilos * 2")
    assert r.columns == ["id", "kilos * 2", "n", "[1, 2]"] and r.rows == [(10, 7.0, 1, [1.0, 2.0])]
    db.execute("INSERT INTO parcels (label, id, kilos) VALUES ('sum', 3 + 4, 9 / 2), ('norm', 8, vector_norm([3, 4])), ('null', 9, NULL)")
    assert rows(db, "SELECT id, kilos FROM parcels WHERE id < 10 ORDER BY id") == [(7, 4.0), (8, 5.0), (9, None)]


def test_pages_beyond_32_bits(db, spark):
    assert rows(db, "SELECT id FROM parcels ORDER BY id LIMIT 9000000000000000000 OFFSET 4") == [(50,), (60,)]
    assert rows(db, "SELECT id FROM parcels ORDER BY id OFFSET 3000000000") == rows(db, "SELECT COUNT(*) FROM parcels LIMIT 1 OFFSET 5000000000") == []
    db.attach("far", spark.range(100))
    assert rows(db, "SELECT id FROM far ORDER BY id DESC LIMIT 3000000000 OFFSET 97") == [(2,), (1,), (0,)]
    assert rows(db, "SELECT id FROM far OFFSET 3000000000") == [] and len(rows(db, "SELECT DISTINCT id % 7 FROM far LIMIT 3000000000")) == 7


def test_attached_files_keep_their_order(spark, tmp_path):
    from quarry.sources.parquet import attach_path

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "1 AS same").coalesce(1).write.mode("append").parquet(str(tmp_path / f"t/p={i}"))
    db = Database(spark)
    db.tables["t"] = attach_path(spark, "t", str(tmp_path / "t"))
    assert [r[0] for r in rows(db, "SELECT id FROM t ORDER BY same LIMIT 12")] == list(range(12))
    assert "row_index" not in db.sql("SELECT id FROM t WHERE id > 3")._jdf.queryExecution().executedPlan().toString()


def test_equal_scores_keep_insertion_order(spark):
    db = Database(spark)
    db.execute("CREATE TABLE same (n INTEGER PRIMARY KEY, v VECTOR(5))")
    db.insert_rows("same", [(900 - i, [0.5, 0, 0, 1.5, 2]) for i in range(700)])
    frame = db.sql("SELECT n FROM same ORDER BY dot_product(v, [1, 1, 1, 1, 1]) DESC LIMIT 15 OFFSET 2")
    assert [r[0] for r in frame.collect()] == list(range(898, 883, -1))
    assert "TakeOrderedAndProject" in frame._jdf.queryExecution().executedPlan().toString()


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(41)
    m, q = rng.uniform(-2, 2, (60, 17)).astype(np.float32), rng.uniform(-2, 2, 17).astype(np.float32)
    db = Database(spark)
    db.execute("CREATE TABLE v (n INTEGER, e VECTOR(17))")
    db.insert_rows("v", [(i, x.tolist()) for i, x in enumerate(m)])
    text = "[" + ",".join(repr(float(x)) for x in q) + "]"
    got = np.array([r[1:] for r in rows(db, f"SELECT n, cosine_distance(e, {text}), e <-> {text}, inner_product({text}, e), squared_l2_distance(e, {text}), norm(e) FROM v ORDER BY n")])
    a, b = m.astype(float), q.astype(float)
    dot, d2, size = a @ b, ((a - b) ** 2).sum(1), np.sqrt((a * a).sum(1))
    want = np.stack([np.float32(1 - dot / (size * np.sqrt(b @ b))), np.sqrt(d2), dot, d2, size], 1)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-7)


def test_indexes_and_explain(db):
    db.execute("CREATE INDEX by_depot ON parcels (depot); CREATE INDEX by_sent ON parcels USING HASH (sent); CREATE INDEX IF NOT EXISTS by_sent ON parcels (sent)")
    for where, n in (("depot = 'south' AND sent = TRUE", 2), ("sent = FALSE OR depot = 'north'", 3), ("'south' = depot AND kilos > 1", 2), ("depot = 'south' OR kilos > 1", 6)):
        assert db.query(f"SELECT id FROM parcels WHERE {where}").rows_examined == n
    plan = [r[0] for r in rows(db, "EXPLAIN SELECT id, place <-> [1, 0, 0] AS far FROM parcels WHERE sent = TRUE ORDER BY far LIMIT 3 OFFSET 1")]
    assert plan[0] == "Scan: scalar hash index on parcels (3 of 6 row(s))" and plan[1] == "Filter: sent = true (covered by scalar hash index)"
    assert plan[3].startswith("VectorTopK: ") and "retain 4 row(s)" in plan[3] and plan[4:] == ["Compute: CPU exact scan (3 candidate(s) x 3 dimensions)", "Offset: 1", "Limit: 3"]
    plan = "\n".join(r[0] for r in rows(db, "EXPLAIN SELECT depot, SUM(kilos) AS total FROM parcels GROUP BY depot HAVING SUM(kilos) > 2 ORDER BY total"))
    for step in ("Scan: sequential on parcels (6 row(s))", "Aggregate: group by depot", "Having: SUM(kilos) > 2", "Sort: total"):
        assert step in plan
    assert any(x[0].startswith("Spark: ") for x in rows(db, "EXPLAIN VERBOSE SELECT 1 FROM parcels"))
    db.execute("DROP INDEX by_depot, by_sent; DROP INDEX IF EXISTS by_depot")
    assert db.list_indexes("parcels") == []


def test_intent(db):
    i = db.query_intent("SELECT * FROM parcels WHERE sent = FALSE OFFSET 2")
    assert [c.role for c in i.columns] == ["identifier", "content", "attribute", "attribute", "attribute", "embedding"]
    assert (i.filter, i.limit, i.offset) == ("sent = false", None, 2) and i.summary.startswith("Read 6 selected columns from 'parcels'")
    i = db.query_intent("SELECT label, dot_product([1, 0, 0], place) AS score FROM parcels ORDER BY score DESC LIMIT 1")
    v = i.vector_search
    assert (v.metric, v.column, v.dimensions, v.descending, v.optimized, i.columns[1].role) == ("dot_product", "place", 3, True, True, "similarity_score")
    assert db.query_intent("SELECT depot, COUNT(*) FROM parcels GROUP BY depot").columns[1].role == "aggregate"
    for bad in ("DROP TABLE parcels", "SELECT 1; SELECT 2"):
        with pytest.raises(E.InvalidQuery):
            db.query_intent(bad)


def test_row_budget(db):
    assert len(db.execute("SELECT id FROM parcels; SELECT 1", 7)[0].rows) == 6
    with pytest.raises(E.ResultLimitExceeded, match="at least 6 rows; maximum is 5"):
        db.execute("SELECT label FROM parcels", 5)


def test_typed_values():
    for bad in ([math.nan], [0.0, -math.inf], [1.0, 4e38]):
        with pytest.raises(E.NonFiniteVectorElement):
            type_of(bad)
    with pytest.raises(E.TypeMismatch):
        type_of([1.0, True])
