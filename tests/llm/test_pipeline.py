"""The pipeline's stages against plain versions, and the queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import neardup, pieces, queries


def test_queries_give_what_their_sql_gives(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, query in queries.queries().items():
        df = query(spark, sf)
        rows = df.collect()
        assert len(rows) > 0
        if name in queries.SQL:
            want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
            assert sorted(str(tuple(r)) for r in rows) == sorted(map(str, want)), name


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], sf)
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    texts = [k.select("doc_id", "text").collect() for k in kept]
    assert len(texts[1]) <= len(texts[0])
    first = {}
    for r in sorted(texts[1]):
        first.setdefault(r["text"], r["doc_id"])
    assert sorted(r["doc_id"] for r in texts[2]) == sorted(first.values())
    from test_operators import near_brute

    want = [r[0] for r in near_brute([tuple(r) for r in texts[2]]) if r[3]]
    assert sorted(r["doc_id"] for r in texts[3]) == sorted(want)
    sizes = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert sizes(texts[4]) == pytest.approx(1.5 * sizes(texts[3]), rel=0.02)
    p = pieces.Pieces(open(pieces.MODEL, "rb").read())  # noqa: SIM115
    coded = kept[5].collect()
    assert sorted((r["doc_id"], r["text"]) for r in coded) == sorted(map(tuple, texts[4]))
    assert all(p.decode(r["ids"]).decode() == r["text"] and r["n_tokens"] == len(r["ids"]) for r in coded)


def test_odd_rows_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", "en", "s", 0), (9003, "a b", None, None, 3)], docs.schema)).withColumn("score", F.lit("x")).withColumn("size", F.lit(1))
    for table in (odd, odd.limit(0)):
        out = table
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, sf)
            assert i == 4 or out.columns == odd.columns, name
            rows = out.collect()
            out = spark.createDataFrame(rows, out.schema)
        assert (len(rows) > 0) == (table is odd)
    assert neardup.keep_first(odd).count() > 0
