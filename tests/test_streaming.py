from presslens.plans import learning
from presslens.streaming import articles as s

SF = "/root/testdata/sf0.001"


def test_stream_matrix_equals_batch(spark):
    got = sorted(map(tuple, learning.streamed_matrix(spark, SF).select("phrase", "domain", "n").collect()))
    assert got == sorted(map(tuple, learning.batch_matrix(spark, SF).select("phrase", "domain", "n").collect())) and got


def test_counts_add_up(spark):
    a = spark.createDataFrame([("x", "d", 1)], "phrase string, domain string, n bigint")
    assert s.merge_counts(a, a).first()["n"] == 2
