"""A stage of the pipeline takes one Python worker a task, and no workers of another kind beside those."""

import pyarrow as pa
from pyspark.sql import SparkSession

from reelspan.llm import language_id, line_dedup, packing
from reelspan.llm.common import table


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_language_is_predicted_once_a_row(spark, sf):
    docs = table(spark, sf, "documents")
    kept = language_id.keep_identified(spark, docs)
    assert physical(kept).count("ArrowEvalPython") == 1
    predicted = language_id.predicted(docs, language_id.fit(docs)).collect()
    expected = [r.doc_id for r in predicted if r._lang.lang_pred != language_id.UNKNOWN and r._lang.beyond >= 0]
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(expected)


def test_the_packing_plan_reaches_spark_as_arrow(spark, sf, monkeypatch):
    made, own = [], SparkSession.createDataFrame
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **k: made.append(type(data).__name__) or own(self, data, *a, **k))
    pieces = packing.pack_documents(spark, table(spark, sf, "documents")).collect()
    assert made == ["Table"]
    assert packing.pack_documents(spark, table(spark, sf, "documents").limit(0)).count() == 0
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY


def test_keys_of_a_batch_come_in_parts():
    texts = [f"a line of document {i}\nshort\nA LINE of document {i} \na common line" for i in range(1201)]
    batch = pa.record_batch([pa.array(range(1201), pa.int64()), pa.array([t.encode() for t in texts])], names=["doc_id", "text"])
    found = list(line_dedup._keys_of(10)(iter([batch])))
    assert len(found) == 3
    rows = pa.Table.from_batches(found).to_pylist()
    assert [r["doc_id"] for r in rows] == [i for i in range(1201) for _ in range(2)]
    assert len({(r["h1"], r["h2"]) for r in rows}) == 1202
