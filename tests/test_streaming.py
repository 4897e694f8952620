from pyspark.sql import functions as F

from ledgerlens.operators.jobs import job_state
from ledgerlens.streaming.jobs import keep_state, read_events


def test_stream_ends_at_the_batch_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    seen = {}

    def write(batch, _):
        for r in batch.collect():
            seen[r["user_id"]] = (r["status"], r["n_events"])

    stream = read_events(spark, str(tmp_path / "in"), "user_id long, ts timestamp, event_id long, status string", files=1)
    keep_state(stream, "user_id", write, str(tmp_path / "at")).awaitTermination()
    assert seen == {r["user_id"]: (r["status"], r["n_events"]) for r in job_state(events, "user_id").collect()}
