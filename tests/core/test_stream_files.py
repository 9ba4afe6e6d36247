from feedlake.plans import report_queries as q

SF = "/root/testdata/sf0.001"


def test_appended_rows_are_files_not_a_memory_table(spark):
    for run in (q.cooldown_stream, q.observation_stream, q.stream_distinct):
        out = run(spark, SF)
        assert out.count() and out.inputFiles()


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(40).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (sorted(map(tuple, run(spark, str(tmp_path)).collect())) for run in (q.observation_stream, q.observation))
    assert want and got == want
