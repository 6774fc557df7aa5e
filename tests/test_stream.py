from pyspark.sql import functions as F

from crowdtide.operators.graph_build import accumulate_weights, mention_edges
from crowdtide.streaming.incremental import compact_graph, read_graph, update_graph


def _posts(spark, first, last):
    return spark.range(first, last).select(
        F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("UserID"),
        F.concat(F.lit("hi @n"), (F.col("id") % 4).cast("string")).alias("Content"),
    )


def _graph(df):
    return {tuple(r) for r in df.collect()}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    users = spark.createDataFrame([(f"id{i}", f"N{i}") for i in range(4)], "id string, Username string")
    landed, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    edges_of = lambda posts: mention_edges(posts, users)
    _posts(spark, 0, 50).write.parquet(landed)
    stream = spark.readStream.schema("UserID string, Content string").option("maxFilesPerTrigger", 3).parquet(landed)

    update_graph(stream, edges_of, out, state).awaitTermination()
    first = _graph(read_graph(spark, out))
    assert first == _graph(accumulate_weights(edges_of(_posts(spark, 0, 50))))

    update_graph(stream, edges_of, out, state).awaitTermination()
    assert _graph(read_graph(spark, out)) == first

    _posts(spark, 50, 80).write.mode("append").parquet(landed)
    update_graph(stream, edges_of, out, state).awaitTermination()
    whole = _graph(read_graph(spark, out))
    assert whole == _graph(accumulate_weights(edges_of(_posts(spark, 0, 80))))
    tables = lambda: len(list((tmp_path / "out").glob("first=*/last=*")))
    assert tables() > 3
    compact_graph(spark, out)
    assert tables() == 1 and _graph(read_graph(spark, out)) == whole

    _posts(spark, 80, 95).write.mode("append").parquet(landed)
    update_graph(stream, edges_of, out, state).awaitTermination()
    assert tables() > 1
    compact_graph(spark, out)
    assert tables() == 1
    assert _graph(read_graph(spark, out)) == _graph(accumulate_weights(edges_of(_posts(spark, 0, 95))))
