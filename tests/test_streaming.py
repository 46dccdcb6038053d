import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import cases, extract
from casewright.operators import text as T
from casewright.streaming import operators as X

T0 = dt.datetime(2024, 1, 1)
ATTEMPTS = "user_id bigint, event_id bigint, ts timestamp, success boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, was)


def test_lockouts_in_any_order_of_arrival(rocks, tmp_path):
    """Attempts come shuffled within the watermark over several micro-batches; a far later one ends the stream."""
    spark, rng = rocks, random.Random(2)
    rows = [(u, 100 * u + i, T0 + dt.timedelta(minutes=i + (3000 if i > 13 else 0)), (i + u) % 9 == 0) for u in (1, 2, 3) for i in range(20)]
    df = spark.createDataFrame(rows, ATTEMPTS)
    expected = {(r["user_id"], r["event_id"], r["run"], r["locked_until"]) for r in X.lockouts(df, idle="1 DAY").collect()}
    assert expected and expected != {(r["user_id"], r["event_id"], r["run"], r["locked_until"]) for r in X.lockouts(df).collect()}
    early, late = [r for r in rows if r[1] % 100 <= 13], [r for r in rows if r[1] % 100 > 13]
    for part in (early, late):
        rng.shuffle(part)
    for n, part in enumerate((early[:20], early[20:], late[:9], late[9:], [(9, 999, T0 + dt.timedelta(days=30), True)], [(9, 1000, T0 + dt.timedelta(days=31), True)])):
        spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = X.lockouts_stream(stream, late="1 hour").writeStream.format("memory").queryName("lockouts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = [(r["user_id"], r["event_id"], r["run"], r["locked_until"]) for r in spark.table("lockouts").collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_request_limits(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=10 * i)) for i in range(9)], "user_id bigint, ts timestamp")
    got = X.request_limits(df, window="1 minute", most=5).orderBy("window_start").collect()
    assert [(r["n"], r["over_limit"]) for r in got] == [(6, True), (3, False)]


def test_ingest_stops_repeats_and_goes_on(spark, tmp_path):
    rows = [("c" if i % 3 else None, f"f{i % 4}", i, f"El Cabo Juan Pérez vio a Ana Ruiz.{chr(10) * 2}" * (i + 1)) for i in range(20)]
    docs = spark.createDataFrame(rows, "case_id string, file string, doc_id int, text string")
    path, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    sizes = {"size": 200, "overlap": 20, "window": 40}

    def take(part) -> None:
        part.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        X.ingest(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), path, cp, every=2, **sizes).awaitTermination(240)

    def same(part) -> None:
        per = extract.document_frequency(extract.mentions(part))
        told = lambda df: sorted(map(tuple, df.select("case_id", "kind", "name", "mentions", "n_files").collect()), key=repr)
        assert told(X.merged_counts(spark, path)) == told(extract.global_counts(per))
        assert X.ingested_chunks(spark, path).count() == T.chunk_text(part, **sizes).count()

    take(docs.filter("doc_id < 9"))
    same(docs.filter("doc_id < 9"))
    n = spark.read.parquet(f"{path}/ledger").count()
    spark.read.parquet(f"{path}/counts/batch={n - 1}").write.parquet(f"{path}/counts/batch={n}")  # a batch that stopped before its ledger row
    same(docs.filter("doc_id < 9"))
    take(docs.filter("doc_id >= 9"))  # goes on after the restart, and writes that batch again
    same(docs)


def test_summaries_are_computed_for_changed_cases_alone(spark, tmp_path):
    asked = []

    def run(rows):
        def compute(few):
            asked.append(sorted(r[0] for r in few.collect()))
            return rows.join(few, "case_id", "left_semi").groupBy("case_id").agg(F.sum("x").alias("total"))

        return {r["case_id"]: r["total"] for r in cases.cached_summaries(rows, ["x"], compute, str(tmp_path / "cache")).collect()}

    df = lambda rows: spark.createDataFrame(rows, "case_id string, x int")
    assert run(df([("a", 1), ("a", 2), ("b", 3)])) == {"a": 3, "b": 3}
    assert run(df([("b", 3), ("a", 2), ("a", 1)])) == {"a": 3, "b": 3}
    assert run(df([("b", 4), ("a", 2), ("a", 1), ("d", 9)])) == {"a": 3, "b": 4, "d": 9}
    assert run(df([("b", 4), ("d", 9)])) == {"b": 4, "d": 9}
    assert asked == [["a", "b"], ["b", "d"], []]
