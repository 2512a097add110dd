"""Queries of the engine on the given tables, and SQL that gives the same rows.

Most are written in the dialect and compiled by the engine; the SQL beside them is DuckDB's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.database import Database
from quarry.functions import vector as V
from quarry.types import DOUBLE, INTEGER, TEXT, Column, vector

DIMS = 64
E1 = [1.0] + [0.0] * (DIMS - 1)
Q = "ARRAY[" + ", ".join("1" if i == 0 else "0" for i in range(DIMS)) + "]"
QD = "[" + ", ".join("1" if i == 0 else "0" for i in range(DIMS)) + "]::DOUBLE[]"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables(dict):
    """Tables of a folder, attached when a query names them."""

    def __init__(self, db: Database, sf_dir: str):
        super().__init__()
        self.db, self.dir = db, sf_dir

    def __contains__(self, name):
        return name in TABLES or dict.__contains__(self, name)

    def __missing__(self, name):
        if name not in TABLES:
            raise KeyError(name)
        from quarry.sources.parquet import attach_path

        self[name] = attach_path(self.db.spark, name, f"{self.dir}/{name}.parquet", {"embedding": DIMS})
        return self[name]


def database(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.tables = Tables(db, sf_dir)
    return db


def _sql(text: str):
    return lambda spark, sf_dir: database(spark, sf_dir).sql(text)


def _round(query, *names: str):
    """Distances rounded to six places, on both sides of a comparison."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.select(*(F.round(F.col(c), 6).alias(c) if c in names else F.col(c) for c in df.columns))

    return run


def _dist(kind: str, a: str = "embedding::DOUBLE[]", b: str = QD) -> str:
    dot = f"list_inner_product({a}, {b})"
    return {
        "cosine": f"round((1 - {dot} / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))::FLOAT::DOUBLE, 6)",
        "l2": f"round(list_distance({a}, {b}), 6)", "squared": f"round(list_distance({a}, {b}) ** 2, 6)", "dot": f"round({dot}, 6)", "negative": f"round(-{dot}, 6)",
    }[kind]


# name: (dialect, DuckDB SQL or None where it is the same text, columns to round)
SAME = None
PLAIN: dict[str, tuple] = {
    "scan_all": ("SELECT * FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region", ()),
    "project_expr": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_orderkey + 1 AS next_key FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_orderkey + 1 AS next_key FROM lineitem", ()),
    "literal_row": ("SELECT 1 AS one, 'a' AS a, TRUE AS yes, 1.5 AS x", "SELECT 1::BIGINT AS one, 'a' AS a, TRUE AS yes, 1.5::DOUBLE AS x", ()),
    "filter_compare": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_nationkey <> 3 AND c_mktsegment = 'BUILDING'", SAME, ()),
    "filter_bool_3vl": ("SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND (p_retailprice < 1000 OR p_brand = 'Brand#11'))", SAME, ()),
    "filter_between": ("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15", SAME, ()),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 15", SAME, ()),
    "filter_in": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 2)", ()),
    "filter_not_in": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')", SAME, ()),
    "filter_in_null": ("SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, NULL) OR n_regionkey IN (2, NULL)", SAME, ()),
    "filter_null_constant": ("SELECT n_name FROM nation WHERE NULL", SAME, ()),
    "filter_paren": ("SELECT s_suppkey FROM supplier WHERE ((s_acctbal) > (0)) AND (s_nationkey = 1 OR s_nationkey = 2)", SAME, ()),
    "like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ed%g_t'", SAME, ()),
    "not_like": ("SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1_'", SAME, ()),
    "ilike": ("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'e_On%y'", SAME, ()),
    "not_ilike": ("SELECT doc_id FROM documents WHERE text NOT ILIKE '%THE%'", SAME, ()),
    "is_null": ("SELECT doc_id FROM documents WHERE text IS NULL OR source IS NOT NULL", SAME, ()),
    "is_true": ("SELECT p_partkey FROM part WHERE (p_size > 20) IS TRUE AND (p_size > 40) IS NOT TRUE AND (p_size = 30) IS FALSE", SAME, ()),
    "int_div_mod": ("SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, -o_orderkey / 7 AS nq, -o_orderkey % 7 AS nr FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, -(o_orderkey // 7) AS nq, -(o_orderkey % 7) AS nr FROM orders", ()),
    "float_arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit, l_extendedprice - l_quantity AS d, l_quantity + 1 AS p FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice / l_quantity AS unit, l_extendedprice - l_quantity AS d, l_quantity + 1 AS p FROM lineitem", ()),
    "unary_minus": ("SELECT s_suppkey, -s_acctbal AS neg, +s_suppkey AS pos FROM supplier", SAME, ()),
    "cast_int_double": ("SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_name AS TEXT) AS name, p_size::FLOAT AS again FROM part", "SELECT p_partkey, p_size::DOUBLE AS size, p_name AS name, p_size::DOUBLE AS again FROM part", ()),
    "agg_global": ("SELECT COUNT(*) AS n, COUNT(l_tax) AS c, SUM(l_orderkey) AS s, AVG(l_quantity) AS a, MIN(l_discount) AS lo, MAX(l_returnflag) AS hi FROM lineitem", "SELECT COUNT(*) AS n, COUNT(l_tax) AS c, SUM(l_orderkey)::BIGINT AS s, round(AVG(l_quantity), 6) AS a, MIN(l_discount) AS lo, MAX(l_returnflag) AS hi FROM lineitem", ("a",)),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_name) AS lo, MAX(p_size) AS hi FROM part WHERE p_size < 0", "SELECT COUNT(*) AS n, SUM(p_size)::BIGINT AS s, AVG(p_size) AS a, MIN(p_name) AS lo, MAX(p_size)::BIGINT AS hi FROM part WHERE p_size < 0", ()),
    "agg_no_from": ("SELECT COUNT(*) AS n", SAME, ()),
    "agg_group": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_extendedprice) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 6) AS q, round(AVG(l_extendedprice), 6) AS a FROM lineitem GROUP BY ALL", ("q", "a")),
    "agg_group_expr": ("SELECT p_size % 5 AS bucket, COUNT(*) AS n, MAX(p_retailprice) AS hi FROM part GROUP BY p_size % 5", "SELECT (p_size % 5)::BIGINT AS bucket, COUNT(*) AS n, MAX(p_retailprice) AS hi FROM part GROUP BY 1", ()),
    "agg_group_null": ("SELECT (p_size > 25) IS TRUE AS big, COUNT(*) AS n FROM part GROUP BY (p_size > 25) IS TRUE", "SELECT p_size > 25 AS big, COUNT(*) AS n FROM part GROUP BY 1", ()),
    "agg_count_distinct": ("SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_returnflag) AS m FROM lineitem", "SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_returnflag) AS m FROM lineitem", ()),
    "agg_sum_distinct": ("SELECT SUM(DISTINCT p_size) AS s, AVG(DISTINCT p_size) AS a FROM part", "SELECT SUM(DISTINCT p_size)::BIGINT AS s, AVG(DISTINCT p_size) AS a FROM part", ()),
    "agg_having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", SAME, ()),
    "agg_expr_over_agg": ("SELECT c_mktsegment, COUNT(*) + 1 AS n1, CAST(COUNT(*) AS FLOAT) AS f, MIN(c_name) LIKE 'C%' AS c, COUNT(*) BETWEEN 1 AND 1000000 AS b, MAX(c_acctbal) IS NULL AS z FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, COUNT(*) + 1 AS n1, COUNT(*)::DOUBLE AS f, MIN(c_name) LIKE 'C%' AS c, COUNT(*) BETWEEN 1 AND 1000000 AS b, MAX(c_acctbal) IS NULL AS z FROM customer GROUP BY c_mktsegment", ()),
    "agg_order_limit": ("SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10", "SELECT o_custkey, round(SUM(o_totalprice), 6) AS total FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10", ("total",)),
    "agg_distinct": ("SELECT DISTINCT COUNT(*) AS n FROM nation GROUP BY n_regionkey", SAME, ()),
    "agg_over_norm": ("SELECT label, AVG(vector_norm(embedding)) AS a, COUNT(*) AS n FROM embeddings GROUP BY label", "SELECT label::BIGINT AS label, round(AVG(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS a, COUNT(*) AS n FROM embeddings GROUP BY label", ("a",)),
    "agg_events": ("SELECT event_type, COUNT(*) AS n, SUM(value) AS v, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type", "SELECT event_type, COUNT(*) AS n, round(SUM(value), 4) AS v, COUNT(DISTINCT user_id) AS u FROM events GROUP BY event_type", ()),
    "order_multi": ("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC, c_acctbal, c_custkey", "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer", ()),
    "topk_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 7", SAME, ()),
    "limit_offset_wide": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 9000000000000000000 OFFSET 30", "SELECT p_partkey FROM part ORDER BY p_partkey OFFSET 30", ()),
    "ties_by_place": ("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC LIMIT 40 OFFSET 5", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40 OFFSET 5", ()),
    "limit_offset": ("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30", SAME, ()),
    "distinct": ("SELECT DISTINCT p_brand, p_size FROM part", "SELECT DISTINCT p_brand, p_size::BIGINT AS p_size FROM part", ()),
    "distinct_order_foreign": ("SELECT DISTINCT n_regionkey FROM nation ORDER BY n_nationkey LIMIT 3", "SELECT n_regionkey::BIGINT AS n_regionkey FROM nation GROUP BY 1 ORDER BY min(n_nationkey) LIMIT 3", ()),
    "like_long_text": ("SELECT page_id FROM pages WHERE html LIKE '%<article>%' AND url LIKE 'http%'", SAME, ()),
    "conversations_order": ("SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn DESC LIMIT 50", SAME, ()),
    "labels_group": ("SELECT quality, toxic, COUNT(*) AS n FROM labels GROUP BY quality, toxic", "SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, COUNT(*) AS n FROM labels GROUP BY ALL", ()),
    "vec_cosine_topk": (f"SELECT vec_id, cosine_distance(embedding, {Q}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 10", f"SELECT vec_id, {_dist('cosine')} AS d FROM embeddings ORDER BY 1 - list_inner_product(embedding::DOUBLE[], {QD}) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), vec_id LIMIT 10", ("d",)),
    "vec_l2_topk": (f"SELECT vec_id, l2_distance(embedding, {Q}) AS d FROM embeddings ORDER BY d LIMIT 10", f"SELECT vec_id, {_dist('l2')} AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {QD}) LIMIT 10", ("d",)),
    "vec_sql2_topk": (f"SELECT vec_id, squared_l2_distance(embedding, {Q}) AS d FROM embeddings ORDER BY d LIMIT 10", f"SELECT vec_id, {_dist('squared')} AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {QD}) LIMIT 10", ("d",)),
    "vec_dot_topk": (f"SELECT vec_id, dot_product(embedding, {Q}) AS d FROM embeddings ORDER BY d DESC LIMIT 10", f"SELECT vec_id, {_dist('dot')} AS d FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {QD}) DESC LIMIT 10", ("d",)),
    "vec_euclidean": (f"SELECT vec_id, euclidean_distance({Q}, embedding) AS d, inner_product(embedding, {Q}) AS p FROM embeddings", f"SELECT vec_id, {_dist('l2')} AS d, {_dist('dot')} AS p FROM embeddings", ("d", "p")),
    "vec_op_cosine": (f"SELECT vec_id, embedding <=> {Q} AS d FROM embeddings", f"SELECT vec_id, {_dist('cosine')} AS d FROM embeddings", ("d",)),
    "vec_op_l2": (f"SELECT vec_id, embedding <-> {Q} AS d FROM embeddings", f"SELECT vec_id, {_dist('l2')} AS d FROM embeddings", ("d",)),
    "vec_op_negdot": (f"SELECT vec_id, embedding <#> {Q} AS d FROM embeddings", f"SELECT vec_id, {_dist('negative')} AS d FROM embeddings", ("d",)),
    "vec_dims": ("SELECT vec_id, vector_dims(embedding) AS n, dimensions(embedding) AS m FROM embeddings", "SELECT vec_id, len(embedding) AS n, len(embedding) AS m FROM embeddings", ()),
    "vec_norm": ("SELECT vec_id, vector_norm(embedding) AS n, norm(embedding) AS m FROM embeddings", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS n, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS m FROM embeddings", ("n", "m")),
    "vec_normalize": (f"SELECT vec_id, vector_norm(normalize(embedding)) AS n, dot_product(normalize_vector(embedding), {Q}) AS d FROM embeddings", f"SELECT vec_id, 1.0::DOUBLE AS n, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS d FROM embeddings", ("n", "d")),
    "vec_equality": (f"SELECT vec_id, embedding = embedding AS same, embedding <> {Q} AS d, embedding = {Q} AS e FROM embeddings", f"SELECT vec_id, embedding = embedding AS same, embedding::DOUBLE[] <> {QD} AS d, embedding::DOUBLE[] = {QD} AS e FROM embeddings", ()),
    "vec_constructor": ("SELECT vector_norm(VECTOR(3, 4)) AS n, vector_dims(ARRAY[1, 2, 3]) AS d, dot_product([1, 2], VECTOR(3, 4)) AS p", "SELECT 5.0::DOUBLE AS n, 3::BIGINT AS d, 11.0::DOUBLE AS p", ()),
    "vec_topk_filtered": (f"SELECT vec_id, label, cosine_distance(embedding, {Q}) AS d FROM embeddings WHERE label = 3 ORDER BY d LIMIT 20", f"SELECT vec_id, label::BIGINT AS label, {_dist('cosine')} AS d FROM embeddings WHERE label = 3 ORDER BY 1 - list_inner_product(embedding::DOUBLE[], {QD}) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) LIMIT 20", ("d",)),
    "vec_topk_offset": (f"SELECT vec_id, l2_distance(embedding, {Q}) AS d FROM embeddings ORDER BY d DESC LIMIT 4 OFFSET 2", f"SELECT vec_id, {_dist('l2')} AS d FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {QD}) DESC LIMIT 4 OFFSET 2", ("d",)),
    "vec_group_avg_distance": (f"SELECT label, AVG(embedding <-> {Q}) AS d FROM embeddings GROUP BY label HAVING COUNT(*) > 1", f"SELECT label::BIGINT AS label, round(AVG(list_distance(embedding::DOUBLE[], {QD})), 6) AS d FROM embeddings GROUP BY label HAVING COUNT(*) > 1", ("d",)),
}


def _order_nulls(spark, sf_dir):
    """NULLs are made from a value; both default orders and both explicit ones rank the same rows."""
    from quarry.sources.parquet import attach

    db = database(spark, sf_dir)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    db.tables["n"] = attach("n", nation.withColumn("k", F.expr("nullif(n_regionkey, 2)")))
    parts = []
    for how in ("k, n_nationkey", "k DESC, n_nationkey", "k NULLS FIRST, n_nationkey", "k DESC NULLS LAST, n_nationkey"):
        parts.append(db.sql(f"SELECT n_nationkey, k FROM n ORDER BY {how} LIMIT 7").select(F.lit(how).alias("how"), "n_nationkey", "k"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _null_logic(spark, sf_dir):
    from quarry.sources.parquet import attach

    db = database(spark, sf_dir)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    db.tables["p"] = attach("p", part.select("p_partkey", F.expr("nullif(p_size, 7)").alias("k"), F.expr("CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END").alias("b")))
    return db.sql("SELECT p_partkey, b AND k > 5 AS a, b OR k > 5 AS o, NOT b AS n, k IN (1, NULL) AS i, k BETWEEN 3 AND 9 AS w, b IS TRUE AS t, b IS NOT FALSE AS f, k IS NULL AS z FROM p")


def _written(name: str, columns: list[Column], source: str, statement, select: str):
    """A write on a copy of a table, and a query over the outcome."""

    def run(spark, sf_dir):
        db = database(spark, sf_dir)
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        from quarry.operators.tables import Table

        db.tables[name] = Table(name, tuple(columns))
        db.insert_rows(name, df.select(*(F.col(c.name).cast(c.type.spark).alias(c.name) for c in columns)))
        statement(db, spark, df)
        return db.sql(select)

    return run


_EVENT = [Column("event_id", INTEGER, False, True), Column("user_id", INTEGER), Column("event_type", TEXT), Column("value", DOUBLE)]
_PLAIN_EVENT = [Column("event_id", INTEGER, False), *_EVENT[1:]]  # no key: the SQL of `insert` gives an id twice where the table's reach over its shift
_VEC = [Column("vec_id", INTEGER, False, True), Column("label", INTEGER), Column("embedding", vector(DIMS))]
_PICK = "SELECT event_id, user_id, event_type, value FROM e"


def _more(df: DataFrame, start: int = 0) -> DataFrame:
    """Events with shifted ids: half of them new."""
    top = df.agg(F.max("event_id")).first()[0]
    return df.select((F.col("event_id") + top // 2 + start).alias("event_id"), "user_id", F.lit("again").alias("event_type"), (F.col("value") + 1).alias("value"))


def _beyond(df: DataFrame) -> DataFrame:
    """Events with ids past the largest: all of them new, whatever the table's size."""
    span = df.agg(F.max("event_id") - F.min("event_id") + 1).first()[0]
    return df.select((F.col("event_id") + span).alias("event_id"), "user_id", F.lit("again").alias("event_type"), (F.col("value") + 1).alias("value"))


def _small(db, spark, df):
    db.execute("INSERT INTO e (event_id, event_type) VALUES (-1, 'x'), (-2, NULL); INSERT INTO e VALUES (-1, 5, 'no', 1), (-3, 5, 'yes', 2) ON CONFLICT (event_id) DO NOTHING; INSERT INTO e VALUES (-2, 7, 'up', 1.5), (-4, 8, 'new', 2) ON CONFLICT (event_id) DO UPDATE SET event_type = excluded.event_type, value = excluded.value + 1")


WRITES = {
    "insert": (_written("e", _PLAIN_EVENT, "events", lambda db, s, df: db.insert_rows("e", _more(df, 10**6)), _PICK),
               "SELECT event_id, user_id, event_type, value FROM events UNION ALL SELECT event_id + (SELECT max(event_id) FROM events) // 2 + 1000000, user_id, 'again', value + 1 FROM events"),
    "insert_keyed": (_written("e", _EVENT, "events", lambda db, s, df: db.insert_rows("e", _beyond(df)), _PICK),
                     "SELECT event_id, user_id, event_type, value FROM events UNION ALL SELECT event_id + (SELECT max(event_id) - min(event_id) + 1 FROM events), user_id, 'again', value + 1 FROM events"),
    "insert_values": (_written("e", _EVENT, "events", _small, _PICK),
                      "SELECT event_id, user_id, event_type, value FROM events UNION ALL VALUES (-1, NULL, 'x', NULL), (-2, NULL, 'up', 2.5), (-3, 5, 'yes', 2), (-4, 8, 'new', 2)"),
    "insert_do_nothing": (_written("e", _EVENT, "events", lambda db, s, df: db.insert_rows("e", _more(df), "do_nothing", "event_id"), _PICK),
                          "WITH n AS (SELECT event_id + (SELECT max(event_id) FROM events) // 2 AS event_id, user_id, 'again' AS event_type, value + 1 AS value FROM events) SELECT event_id, user_id, event_type, value FROM events UNION ALL SELECT * FROM n WHERE event_id NOT IN (SELECT event_id FROM events)"),
    "insert_do_update": (_written("e", _EVENT, "events", lambda db, s, df: db.insert_rows("e", _more(df), "do_update", "event_id", ["event_type", "value"]), _PICK),
                         "WITH n AS (SELECT event_id + (SELECT max(event_id) FROM events) // 2 AS event_id, user_id, 'again' AS event_type, value + 1 AS value FROM events) SELECT coalesce(e.event_id, n.event_id) AS event_id, CASE WHEN e.event_id IS NULL THEN n.user_id ELSE e.user_id END AS user_id, coalesce(n.event_type, e.event_type) AS event_type, coalesce(n.value, e.value) AS value FROM events e FULL JOIN n USING (event_id)"),
    "update": (_written("e", _EVENT, "events", lambda db, s, df: db.execute("UPDATE e SET value = value * 2, user_id = event_id WHERE event_type = 'click' OR user_id < 50"), _PICK),
               "SELECT event_id, CASE WHEN event_type = 'click' OR user_id < 50 THEN event_id ELSE user_id END AS user_id, event_type, CASE WHEN event_type = 'click' OR user_id < 50 THEN value * 2 ELSE value END AS value FROM events"),
    "delete": (_written("e", _EVENT, "events", lambda db, s, df: db.execute("DELETE FROM e WHERE event_type = 'click' OR value > 50"), _PICK),
               "SELECT event_id, user_id, event_type, value FROM events WHERE NOT (event_type = 'click' OR value > 50)"),
    "write_batch": (_written("v", _VEC, "embeddings", lambda db, s, df: db.execute("UPDATE v SET embedding = normalize(embedding); DELETE FROM v WHERE label = 1; UPDATE v SET label = label + 100 WHERE vec_id % 2 = 0"), "SELECT vec_id, label, vector_dims(embedding) AS n FROM v"),
                    "SELECT vec_id, (label + CASE WHEN vec_id % 2 = 0 THEN 100 ELSE 0 END)::BIGINT AS label, 64::BIGINT AS n FROM embeddings WHERE label <> 1"),
}


def search_filters(spark, sf_dir):
    out = database(spark, sf_dir).search("embeddings", "embedding", E1, "cosine", ["vec_id", "label"], [{"column": "label", "operator": "gte", "value": 2}, {"column": "vec_id", "operator": "ne", "value": 5}], 15)
    return out.frame.withColumn("distance", F.round("distance", 6))


def filtered_topk(spark, sf_dir):
    """The flagship: cosine top 20 of the even labels, by the DataFrame API."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("label") % 2 == 0)
    d = V.cosine_distance(F.col("embedding"), E1)
    return e.orderBy(d.asc_nulls_last(), "vec_id").limit(20).select("vec_id", F.col("label").cast("long").alias("label"), F.round(d, 6).alias("distance"))


def explain(spark, sf_dir):
    return spark.createDataFrame(database(spark, sf_dir).query(f"EXPLAIN VERBOSE SELECT vec_id, embedding <=> {Q} AS d FROM embeddings WHERE label = 3 ORDER BY d LIMIT 5 OFFSET 1").rows, "plan string")


def intent(spark, sf_dir):
    i = database(spark, sf_dir).query_intent(f"SELECT vec_id, label, embedding <=> {Q} AS d FROM embeddings WHERE label = 3 ORDER BY d LIMIT 5")
    return spark.createDataFrame([(c.output_name, c.role, i.summary) for c in i.columns], "output_name string, role string, summary string")


def explain_steps(spark, sf_dir):
    """The steps of plans, without Spark's own."""
    db, out = database(spark, sf_dir), []
    for n, text in enumerate((f"SELECT vec_id, embedding <=> {Q} AS d FROM embeddings WHERE label = 3 ORDER BY d LIMIT 5 OFFSET 1", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > 1 ORDER BY n", "SELECT 1 AS one")):
        steps = [r[0] for r in db.query("EXPLAIN " + text).rows]
        out += [(n, i, s.split(" (")[0].split(": ")[0], s if s.startswith(("Scan", "Compute", "Limit", "Having")) else None) for i, s in enumerate(steps)]
    return spark.createDataFrame(out, "query long, step long, kind string, line string")


def definitions(spark, sf_dir):
    """Tables and indexes that are made, used and dropped."""
    db = Database(spark)
    db.execute("CREATE TABLE a (k INTEGER PRIMARY KEY, v TEXT COMMENT 'shown'); CREATE TABLE IF NOT EXISTS a (z INT); CREATE INDEX a_v ON a (v); CREATE TABLE b (k INT); DROP TABLE b; DROP TABLE IF EXISTS c")
    db.execute("INSERT INTO a VALUES (1, 'x'), (2, 'y'), (3, 'x'); CREATE TABLE b (w TEXT, u VECTOR(2)); INSERT INTO b (u) VALUES ([1, 2]); DROP INDEX a_v; DROP INDEX IF EXISTS a_v")
    shape = [(t, c.name, str(c.type), c.nullable, c.unique, db.table_info(t)["rows"]) for t in db.list_tables() for c in db.schema(t)]
    return spark.createDataFrame(shape, "table_name string, column_name string, type string, nullable boolean, is_unique boolean, n long")


def _null_embeddings(spark, sf_dir):
    """Rankings where some embeddings are NULL: last ascending, first descending, ties in insertion order."""
    db = database(spark, sf_dir)
    db.execute(f"CREATE TABLE nv (id INTEGER, v VECTOR({DIMS}))")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 400")
    db.insert_rows("nv", [(r["vec_id"], None if r["vec_id"] % 50 == 7 else list(r["embedding"])) for r in e.orderBy("vec_id").collect()])
    parts = [db.sql(f"SELECT id FROM nv ORDER BY v <-> {Q} {how} LIMIT {n} OFFSET {m}").select(F.lit(how).alias("how"), "id") for how, n, m in (("DESC", 12, 3), ("NULLS FIRST", 10, 4), ("ASC", 10, 0))]
    return parts[0].union(parts[1]).union(parts[2])


def _durable_reopen(spark, sf_dir):
    """A DataFrame of other columns in another order, an upsert and a deletion, a checkpoint between; then closed and opened."""
    from quarry.sources.scratch import scratch_path

    path = scratch_path(spark, "database")
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    db = Database.open_persistent(spark, path)
    db.execute("CREATE TABLE e (event_id INTEGER PRIMARY KEY, user_id INTEGER, event_type TEXT, value DOUBLE)")
    db.insert_rows("e", df.select("value", F.lit(1).alias("more"), "event_type", "user_id", "event_id"))
    db.checkpoint()
    db.insert_rows("e", _more(df).select("event_type", "event_id", "value", "user_id"), "do_update", "event_id", ["event_type", "value"])
    db.execute("DELETE FROM e WHERE user_id < 20; INSERT INTO e (event_id) VALUES (-5)")
    db.close()
    db = Database.open_persistent(spark, path)
    out = db.sql(_PICK)
    db.close()
    return out


def _first_of_each(db, spark, df):
    """Conflicts on two keys: of three rows in a row one user number is new, of two one type."""
    new = df.orderBy("event_id").select((F.col("event_id") + 10**9).alias("event_id"), F.floor(F.col("event_id") / 3).alias("user_id"), F.concat(F.lit("t"), F.floor(F.col("event_id") / 2)).alias("event_type"), F.lit(0.0).alias("value"))
    db.insert_rows("e", new, "do_nothing")


_PAIR = [Column("event_id", INTEGER, False), Column("user_id", INTEGER, True, True), Column("event_type", TEXT, True, True), Column("value", DOUBLE)]


def _two_keys(spark, sf_dir):
    from quarry.operators.tables import Table

    db = database(spark, sf_dir)
    db.tables["e"] = Table("e", tuple(_PAIR))
    db.insert_rows("e", [(-1, -1, "x", 1.0), (-2, 0, None, 1.0)])
    _first_of_each(db, spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
    return db.sql(_PICK)


_E = "1 - list_inner_product(embedding::DOUBLE[], {q}) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))".format(q=QD)
EXTRA_SQL = {
    "order_nulls": "WITH n AS (SELECT n_nationkey::BIGINT AS n_nationkey, nullif(n_regionkey, 2)::BIGINT AS k FROM nation) " + " UNION ALL ".join(
        f"(SELECT '{how}' AS how, n_nationkey, k FROM n ORDER BY {by} LIMIT 7)" for how, by in (
            ("k, n_nationkey", "k NULLS LAST, n_nationkey"), ("k DESC, n_nationkey", "k DESC NULLS FIRST, n_nationkey"), ("k NULLS FIRST, n_nationkey",) * 2, ("k DESC NULLS LAST, n_nationkey",) * 2)),
    "null_logic": "WITH p AS (SELECT p_partkey, nullif(p_size, 7) AS k, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 2 = 0 END AS b FROM part) SELECT p_partkey, b AND k > 5 AS a, b OR k > 5 AS o, NOT b AS n, k IN (1, NULL) AS i, k BETWEEN 3 AND 9 AS w, b IS TRUE AS t, b IS NOT FALSE AS f, k IS NULL AS z FROM p",
    "search_filters": f"SELECT vec_id, label::BIGINT AS label, {_dist('cosine')} AS distance FROM embeddings WHERE label >= 2 AND vec_id <> 5 ORDER BY {_E} LIMIT 15",
    # the steps' kinds; lines where they hang on the tables
    "explain_steps": "WITH e AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT count(*) AS n FROM part) SELECT q AS query, i AS step, kind, line FROM ("
        "SELECT 0::BIGINT q, 0::BIGINT i, 'Scan' kind, 'Scan: sequential on embeddings (' || n || ' row(s))' AS line FROM e UNION ALL SELECT 0, 4, 'Compute', 'Compute: CPU exact scan (' || n || ' candidate(s) x 64 dimensions)' FROM e "
        "UNION ALL SELECT 1, 0, 'Scan', 'Scan: sequential on part (' || n || ' row(s))' FROM p UNION ALL VALUES (0, 1, 'Filter', NULL), (0, 2, 'Projection', NULL), (0, 3, 'VectorTopK', NULL), (0, 5, 'Offset', NULL), (0, 6, 'Limit', 'Limit: 5'), "
        "(1, 1, 'Aggregate', NULL), (1, 2, 'Having', 'Having: COUNT(*) > 1'), (1, 3, 'Projection', NULL), (1, 4, 'Sort', NULL), (2, 0, 'Source', NULL), (2, 1, 'Projection', NULL))",
    "intent": "SELECT *, 'Rank rows from ''embeddings'' by cosine_distance on ''embedding'' after applying a relational filter; return 3 selected columns, limited to 5 rows' AS summary FROM (VALUES ('vec_id', 'attribute'), ('label', 'attribute'), ('d', 'similarity_score')) AS t(output_name, role)",
    "definitions": "SELECT * FROM (VALUES ('a', 'k', 'INTEGER', false, true, 3::BIGINT), ('a', 'v', 'TEXT', true, false, 3), ('b', 'w', 'TEXT', true, false, 1), ('b', 'u', 'VECTOR(2)', true, false, 1)) AS t(table_name, column_name, type, nullable, is_unique, n)",
    "null_embeddings": "WITH nv AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 7 THEN NULL ELSE list_distance(embedding::DOUBLE[], " + QD + ") END AS d FROM embeddings WHERE vec_id < 400) " + " UNION ALL ".join(
        f"(SELECT '{how}' AS how, id FROM nv ORDER BY d {by}, id LIMIT {n} OFFSET {m})" for how, by, n, m in (("DESC", "DESC NULLS FIRST", 12, 3), ("NULLS FIRST", "NULLS FIRST", 10, 4), ("ASC", "NULLS LAST", 10, 0))),
    "durable_reopen": "WITH n AS (SELECT event_id + (SELECT max(event_id) FROM events) // 2 AS event_id, user_id, 'again' AS event_type, value + 1 AS value FROM events), a AS (SELECT coalesce(e.event_id, n.event_id) AS event_id, CASE WHEN e.event_id IS NULL THEN n.user_id ELSE e.user_id END AS user_id, coalesce(n.event_type, e.event_type) AS event_type, coalesce(n.value, e.value) AS value FROM events e FULL JOIN n USING (event_id)) SELECT * FROM a WHERE user_id IS NULL OR user_id >= 20 UNION ALL SELECT -5, NULL, NULL, NULL",
    "insert_two_keys": """WITH RECURSIVE n AS (SELECT event_id, event_id // 3 AS u, event_id // 2 AS t, row_number() OVER (ORDER BY event_id) AS i FROM events),
k(i, event_id, u, t, taken, last_u, last_t) AS (SELECT i, event_id, u, t, u <> 0, CASE WHEN u <> 0 THEN u ELSE -1 END, CASE WHEN u <> 0 THEN t ELSE -1 END FROM n WHERE i = 1
UNION ALL SELECT n.i, n.event_id, n.u, n.t, n.u <> 0 AND n.u <> last_u AND n.t <> last_t, CASE WHEN n.u <> 0 AND n.u <> last_u AND n.t <> last_t THEN n.u ELSE last_u END, CASE WHEN n.u <> 0 AND n.u <> last_u AND n.t <> last_t THEN n.t ELSE last_t END FROM k JOIN n ON n.i = k.i + 1)
SELECT event_id + 1000000000 AS event_id, u AS user_id, 't' || t AS event_type, 0.0::DOUBLE AS value FROM k WHERE taken UNION ALL VALUES (-1, -1, 'x', 1.0), (-2, 0, NULL, 1.0)""",
    "filtered_topk": f"SELECT vec_id, label::BIGINT AS label, {_dist('cosine')} AS distance FROM embeddings WHERE label % 2 = 0 ORDER BY {_E}, vec_id LIMIT 20",
}


def _events_rounded(spark, sf_dir):
    df = _sql(PLAIN["agg_events"][0])(spark, sf_dir)
    return df.withColumn("v", F.round("v", 4))


def queries() -> dict:
    out = {name: _round(_sql(text), *cols) if cols else _sql(text) for name, (text, _, cols) in PLAIN.items()}
    out |= {name: run for name, (run, _) in WRITES.items()}
    return out | {"agg_events": _events_rounded, "order_nulls": _order_nulls, "null_logic": _null_logic, "search_filters": search_filters, "filtered_topk": filtered_topk, "explain": explain, "intent": intent, "explain_steps": explain_steps, "definitions": definitions, "null_embeddings": _null_embeddings, "durable_reopen": _durable_reopen, "insert_two_keys": _two_keys}


def oracle_sql() -> dict[str, str]:
    return {name: sql or text for name, (text, sql, _) in PLAIN.items()} | {name: sql for name, (_, sql) in WRITES.items()} | EXTRA_SQL
