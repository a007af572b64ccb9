import duckdb

from quillon.operators import rank
from quillon.plans import catalogue


def test_knn_cosine_many_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(con.execute(catalogue.ORACLE_SQL["knn_cosine_many"]).fetchall())
    got = sorted(tuple(r) for r in catalogue.QUERIES["knn_cosine_many"](spark, d).collect())
    assert len({x[0] for x in want}) > 1
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))


def test_knn_many_keeps_null_and_zero_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (None, [2.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<float>")
    got = sorted(((r.query_id, r.rank), r.doc_id, r.similarity) for r in rank.knn_many(v, v.filter("doc_id IN (0, 1, 2)"), 2).collect())
    assert got == [((0, 1), None, 1.0), ((0, 2), 0, 1.0), ((1, 1), None, 0.0), ((1, 2), 0, 0.0), ((2, 1), None, 0.0), ((2, 2), 0, 0.0)]
