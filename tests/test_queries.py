"""Every registered query of the library against DuckDB."""

import pytest
from conftest import duck, same_rows

from reelspan.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sliding", "stream_dedupe", "stream_join"])
def test_streams_of_shuffled_files(spark, sf, name, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert len(list(tmp_path.glob("events.parquet/part-*"))) == 20
    same_rows(QUERIES[name](spark, str(tmp_path)), duck(sf), ORACLE_SQL[name])


def test_hand_turns_are_whole(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    answers = {(r.conv_id, r.turn): r.text for r in turns.itertuples() if r.role == "assistant"}
    found = {(r.conv_id, r.turn): r for r in QUERIES["parse_hand_instruction"](spark, sf).collect()}
    asked = [r for r in turns.itertuples() if r.role == "user"]
    assert len(found) == len(asked) and any("\n" in r.text for r in asked) and any(r.turn > 1 for r in asked)
    for r in asked:
        own = found[r.conv_id, r.turn]
        assert (own.left_hand, own.right_hand) == (r.text.rstrip("."), (answers.get((r.conv_id, r.turn + 1)) or "").rstrip(".") or None)


def test_statistics_take_every_finite_vector(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    counts = {r.label: r["count"] for r in vectors.groupBy("label").count().collect()}
    bad = spark.createDataFrame([(-1, [float("nan")] * 64, 0), (-2, [float("inf")] + [0.0] * 63, 0), (-3, [None] + [0.0] * 63, 0), (-4, None, 0)], vectors.schema)
    vectors.unionByName(bad).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["masked_statistics"](spark, str(tmp_path)).collect()
    assert {(r.label, r.num_rows) for r in found} == set(counts.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
