"""The stream of inspected files."""

from provena.operators.tables import Workspace
from provena.streaming.incoming import keep_current

SCHEMA = "real_path string, size_bytes bigint, modified_at string, sha256 string"


def test_stream_upserts_changed_files(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}/ws")
    for rows in ([("a", 1, "t1", "x"), ("b", 1, "t1", "y")], [("a", 1, "t1", "ignored"), ("b", 2, "t2", "z"), ("b", 2, "t3", "last"), ("c", 1, "t1", "n")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        keep_current(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), w, f"{tmp_path}/ck").awaitTermination()
    assert {r["real_path"]: r["sha256"] for r in w.read("images").collect()} == {"a": "x", "b": "last", "c": "n"}
