from corvane.plans import ranking


def test_eval_metrics_reads_whole_documents(spark, tmp_path):
    """A passage behind more than 100,000 identifiers is found."""
    passage = "quokka numbat bilby potoroo"
    docs = [(1, "filler " * 100_001 + passage, 700_034), (2, "nothing of that", 15)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    r = ranking.eval_metrics(spark, str(tmp_path)).first()
    assert (r.cases, r.recall_at_10, r.avg_chars) == (1, 1.0, 700_034.0)
