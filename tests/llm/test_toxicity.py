"""Folding, learned exceptions, held-out accuracy and odd rows of the toxicity lexicon."""
import pytest

from quillon.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS)


@pytest.mark.parametrize("text,want", [("you idiot!", "you idiot"), ("idiot|", "idiot"), ("$5 at 10:30", "5 at 10 30"), ("@$$hole $cum", "asshole scum"), ("1d!0t id1ot", "idiot idiot"),
                                       ("іdіоt", "idiot"), ("IDIOT!! b@d", "idiot bad"), ("a | b", "a b"), ("call 2019", "call 2019"), ("", ""), ("Größe", "größe")])
def test_fold(text, want):
    assert toxicity.fold(text).split() == want.split()


def test_learned_exceptions(spark):
    a = toxicity.automaton({" clown ": 9.0, "clown fish": None}, exceptions=())
    assert toxicity.score_text(a, "the clown fish") == 0 and toxicity.score_text(a, "you clown") > 0.7
    # "clown" itself stands in half of the other rows, so "bad" carries the label; a pair seen in clean rows only is safe
    docs = frame(spark, [(i, "you clown go " if i % 2 else "the clown fish " if i < 60 else "a calm day ") for i in range(4000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model[" clown "] > 0 and model["clown fish"] is None and model["the clown"] is None
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert got == {i: i % 2 for i in range(4000)}


def test_empty_and_one_sided_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, [(1, "you scum"), (2, None)])
    assert toxicity.fit(docs, none) == {} and toxicity.fit(docs.limit(0), none) == {}
    assert toxicity.fit(frame(spark, [(i, "fine words") for i in range(50)]), spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")) == {}
    assert [tuple(r) for r in toxicity.score(docs, {}).collect()] == [(1, 0.0, 0), (2, 0.0, 0)]
    got = toxicity.score(docs.selectExpr("*", "5 AS score", "6 AS predicted"), {" scum ": 9.0}, keep=["doc_id", "score", "lang", "predicted"])
    assert got.columns == ["doc_id", "lang", "score", "predicted"] and [r.predicted for r in got.collect()] == [1, 0]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in toxicity.op4(spark, d).collect() if r.held_out and r.doc_id in labels]
    found, toxic = sum(y and p for y, p in rows), sum(y for y, _ in rows)
    assert found >= 0.9 * toxic and not any(p and not y for y, p in rows)
