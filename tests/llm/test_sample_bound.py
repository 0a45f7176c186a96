"""The bound on the labelled sample holds for rows, also where ids repeat."""

from __future__ import annotations

from stintflow.llm import toxicity


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k % 7}") for k in range(500)] + [(k, f"text {k}") for k in range(2, 40)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in [1, 1, *range(2, 40), 50]], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, ["quality", "toxic"], max_rows=100)
    assert got.columns == ["id", "text", "y", "fold_key"]
    rows = got.collect()
    assert sorted(r.id for r in rows) == [*range(1, 40), 50]
    assert all(r.text == (None if r.id == 50 else f"text {r.id}") for r in rows if r.id != 1)
    again = toxicity.labelled_sample(docs.repartition(5), labels, ["quality", "toxic"], max_rows=100).collect()
    assert {r.id: r.text for r in rows} == {r.id: r.text for r in again}
    assert toxicity.labelled_sample(docs, labels, ["quality", "toxic"], max_rows=10).count() <= 10
