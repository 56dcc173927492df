"""What is left on disk while repeats are cut: only tables that later steps read."""

import os
import tempfile

from reelspan.llm import repeats
from reelspan.llm.suffix_array import dedup_bytes


def test_gram_lists_are_gone_before_texts_and_runs_are_shuffled(spark, monkeypatch):
    folder, held = tempfile.mkdtemp(prefix="spark-"), {}

    def store(df, folder, name, store=repeats.store):
        held[name] = {x for x in os.listdir(folder) if os.path.isdir(f"{folder}/{x}")}
        return store(df, folder, name)

    monkeypatch.setattr(repeats, "store", store)
    passage = "a passage of well over fifty bytes, which two of the documents share"
    docs = spark.createDataFrame([(1, f"one {passage} end"), (2, f"another {passage}!"), (3, "short"), (4, "short"), (5, None), (6, f"one {passage} end")], "doc_id long, text string")
    out = dedup_bytes(docs, folder)
    assert "grams" in held["found"] and held["spans"] == {"found", "copies", "hot", "firsts"}
    assert {x for x in os.listdir(folder)} == {"spans"}
    found = {r.doc_id: (r._cut.n_removed, bytes(r._cut.kept).decode()) for r in out.collect()}
    assert found == {1: (0, f"one {passage} end"), 2: (len(passage) + 1, "another!"), 3: (0, "short"), 4: (0, "short"), 5: (0, ""), 6: (len(passage) + 8, "")}
