"""Streams give what batches give."""

from passagemill.operators import chunk as ch
from passagemill.streaming import incremental as inc


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "one two three four. " * 30, "en", "s", 600), (2, "another text", "en", "s", 12), (3, "another text", "en", "s", 12), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, inc.DOCUMENTS)
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = inc.chunks(inc.drop_copies(inc.read_documents(spark, str(tmp_path / "in"))), "fixed", size=32)
    q = inc.write(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = ch.chunk(docs, "fixed", size=32)
    assert {r.text for r in got.collect()} == {r.text for r in want.collect()}
    assert got.where("doc_id in (2, 3)").count() == 1
    more = inc.write(stream, str(tmp_path / "out"), str(tmp_path / "state"))  # nothing new: nothing is written again
    more.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.count()
