"""Files in and out."""

import json

from pyspark.sql import functions as F

from casewright.sources import corpus


def test_scan_reads_text_files_only(spark, tmp_path):
    (tmp_path / "b.TXT").write_bytes("uno\ndos".encode())
    (tmp_path / "a.txt").write_bytes(b"malo \xff fin")
    (tmp_path / "c.pdf").write_text("no")
    got = [tuple(r) for r in corpus.scan_corpus(spark, str(tmp_path)).orderBy("file").collect()]
    assert got == [("a.txt", "malo � fin"), ("b.TXT", "uno\ndos")]


def test_export_backup_restore(spark, tmp_path):
    t = spark.createDataFrame([(1, ["x", "y"], "a\nb"), (2, [], None)], "id int, tags array<string>, note string")
    corpus.export_tables({"t": t}, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out/csv/t")).collect()
    assert '"1","[""x"",""y""]","a b"' in {r[0].replace('\\"', '""') for r in lines}
    assert spark.read.json(str(tmp_path / "out/json/t")).count() == 2
    corpus.backup({"t": t}, str(tmp_path / "bk"), "20240101")
    corpus.backup({"t": t.limit(1)}, str(tmp_path / "bk"), "20240102")
    assert sorted(map(tuple, corpus.restore(spark, str(tmp_path / "bk"), "t", "20240101").collect()), key=str) == sorted(map(tuple, t.collect()), key=str)


def test_reuse_of_a_written_table(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("PERSONA_001", "Ana")], "alias string, real_name string")

    for _ in range(2):
        got = corpus.read_or_build(spark, str(tmp_path / "alias"), "alias string, real_name string", build)
        assert got.first() == ("PERSONA_001", "Ana")
    assert calls == [1]


def test_results_and_graph_files(spark, tmp_path):
    rows = [{"chunk": {"archivo": "f", "chunk": 1, "inicio": 0, "fin": 9}, "resultado": {"peritos": 3}, "duracion_s": 1.5}, {"chunk": {"archivo": "f", "chunk": 2, "inicio": 5, "fin": 9}, "error": "no"}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    got = corpus.read_results(spark, str(tmp_path / "r.json")).select("chunk.chunk", F.try_variant_get("resultado", "$.peritos", "int").alias("p"), "error").collect()
    assert sorted(map(tuple, got)) == [(1, 3, None), (2, None, "no")]
    n = spark.createDataFrame([("c", "a")], "case_id string, id string")
    corpus.write_graph(n, n, n, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1
    corpus.write_report(n, spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "section int, seq int, line string"), str(tmp_path / "rep"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "rep/report")).collect()] == ["a", "b"]
