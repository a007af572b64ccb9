import re

import numpy as np
import pytest

from quillon.operators import ann, rank

KIND = "doc_id long, embedding array<float>"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, tmp_path, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id AS doc_id", "embedding")
    ann.build(v, str(tmp_path / "ann"))
    assert spark.read.parquet(str(tmp_path / "ann/rows")).count() == v.count()
    q = v.filter("doc_id % 100 = 0")
    want = {(r.query_id, r.doc_id) for r in rank.knn_many(v, q, 5).collect()}
    got = {(r.query_id, r.doc_id) for r in ann.search_many(spark, str(tmp_path / "ann"), q, 5).collect()}
    print(sf, len(want & got) / len(want))
    assert len(want & got) >= 0.9 * len(want)


def test_one_query_reads_few_cells(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, (np.eye(8)[i % 8] + r.normal(0, 0.05, 8)).tolist()) for i in range(400)]
    v = spark.createDataFrame([*rows, (900, None), (901, [0.0] * 8)], KIND)
    ann.build(v, str(tmp_path / "ann"), cells=8)
    near = ann.search(spark, str(tmp_path / "ann"), rows[3][1], 5, probes=1)
    assert [x.doc_id for x in near.collect()] == [x.doc_id for x in rank.knn(v.filter("embedding IS NOT NULL"), rows[3][1], 5).collect()]
    assert re.search(r"PartitionFilters: \[[^\]]*cell", near._jdf.queryExecution().toString())
    with pytest.raises(Exception, match="dimension mismatch"):
        rank.knn(v, [1.0, 0.0], 2).collect()
    with pytest.raises(Exception, match="dimension mismatch"):
        ann.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], KIND), str(tmp_path / "bad"))
