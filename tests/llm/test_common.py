"""Written tables, their sizes and their end."""

from siftworks.llm import common


def test_written_tables_are_weighed_and_dropped(spark):
    since = len(common.PATHS)
    one, path = common.written(spark.range(1000).toDF("a"))
    two, other = common.written(spark.range(10).toDF("a"))
    assert common.PATHS[since:] == [path, other] and common.path_bytes(spark, path) > 0
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.small(one, path)) and not hinted(common.small(one, path, most=999)) and not hinted(common.small(one, path, most_bytes=1))
    common.drop_written(spark, since, keep=(other,))
    assert common.PATHS[since:] == [other] and two.count() == 10
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def test_words_are_counted_as_they_are_split(spark):
    texts = ["", " ", "a", " a  b\t", "\n\x0bx\x1cy z\f", None, "é ü　w"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(common.word_count(common.F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len((t or "").encode().split()) for t in texts]
