import json

from quarry import streaming
from quarry.plans import logic


def test_documents_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(logic.document()))
    q = streaming.document_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    (tmp_path / "in/b.json").write_text("{}")
    q.processAllAvailable()
    q.stop()
    assert sorted((r["dialect"] or "", r["package"] or "") for r in spark.table("arrived").collect()) == [("", ""), ("v4", "depot")]


def test_project_states(spark, tmp_path):
    rows = [("p", "load", 1), ("p", "loaded", 2), ("p", "noise", 9), ("q", "load", 1), ("q", "fail", 3)]
    df = spark.createDataFrame(rows, "project string, message string, ts long")
    want = [("p", "Ready", 2, 2), ("q", "Error", 3, 2)]
    assert sorted(map(tuple, streaming.project_states(df).collect())) == want
    df.write.parquet(str(tmp_path / "m"))
    q = streaming.project_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "m"))).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("states").collect())) == want
