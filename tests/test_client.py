"""The client's fold of job events: the batch query, the stream and the event log agree with a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.client import EVENT, STATE, document_state, job_view
from ledgerlens.operators.jobs import RUNNABLE, STOPPED
from ledgerlens.streaming.client import after, fold_stream
from ledgerlens.streaming.sinks import EventLog, ResultStore

FIELDS = [f.split()[0] for f in EVENT.split(", ")]


def plain_fold(events):
    docs = {}
    for e in sorted({(e[0], e[1]): e for e in events}.values()):
        e = dict(zip(FIELDS, e))
        job = docs.setdefault(e["job"], {})
        if e["doc"] is not None:
            job[e["doc"]] = after(job.get(e["doc"]), e)
        elif e["event"] == "job_status" and e["status"] == "cancelled":
            job.update({k: ("cancelled", *v[1:4], STOPPED) for k, v in job.items() if v[0] in RUNNABLE})
    return {(j, d): (s, n, t, list(o), x) for j, job in docs.items() for d, (s, n, t, o, x) in job.items()}


def made(seed=1, jobs=6, length=40):
    r, out = random.Random(seed), []
    for job in range(jobs):
        for seq in range(1, length + 1):
            doc, event = r.randrange(4), r.choice(["doc_started", "stream", "stream", "page_done", "page_done", "page_done", "doc_done", "doc_error", "job_status"])
            if event == "job_status":
                out.append((job, seq, event, None, r.choice(["running", "cancelled"]), None, None, None, None))
            else:
                pages = event in ("stream", "page_done")
                out.append((job, seq, event, doc, None, seq if pages else None, 99 if pages else None, [f"p{seq}"] if event == "page_done" else None, f"e{seq}" if event == "doc_error" else None))
    return out


def state(df):
    return {(r["job"], r["doc"]): (r["status"], r["done"], r["total"], r["outcomes"], r["error"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rocks(spark):
    conf = {"stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "noDataMicroBatches.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.streaming.{k}", v)
    yield spark
    for k in conf:
        spark.conf.unset(f"spark.sql.streaming.{k}")


def test_batch_fold(spark):
    events = made()
    mixed = events + events[::3]
    random.Random(2).shuffle(mixed)
    df = spark.createDataFrame(mixed, EVENT)
    assert state(document_state(df)) == plain_fold(events)
    one = job_view(df).filter("job = 0").first()
    docs = {k: v for k, v in plain_fold(events).items() if k[0] == 0}
    assert (one["documents"], one["ended"], one["pages"]) == (len(docs), sum(v[0] not in RUNNABLE for v in docs.values()), sum(v[1] for v in docs.values()))
    assert not document_state(df.limit(0)).collect() and not job_view(df.limit(0)).collect()
    assert document_state(df).schema.simpleString() == spark.createDataFrame([], STATE).schema.simpleString()


def test_stream_survives_restart_repeats_and_late_events(rocks, tmp_path):
    events = made(3, jobs=4, length=24)
    seen: dict = {}
    r = random.Random(5)
    late = list(range(len(events)))
    late.sort(key=lambda i: events[i][1] + r.randrange(6))  # a few places out of order
    files = [[events[i] for i in late[k : k + 16]] for k in range(0, len(late), 16)]
    files[2] += files[0]  # sent again

    def write(batch, _):
        seen.update(state(batch))

    def run():
        stream = rocks.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        fold_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    for k, part in enumerate(files):
        rocks.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 2:
            run()  # ends in the middle; the next run goes on from its checkpoint
    run()
    assert seen == plain_fold(events) == state(document_state(rocks.createDataFrame(events, EVENT)))


def test_event_log_gives_snapshot_and_deltas_from_any_batch(spark, tmp_path):
    events = sorted(made(7, jobs=3, length=30), key=lambda e: e[1])
    log = EventLog(spark, str(tmp_path / "log"), every=3)
    parts = [events[k : k + 13] for k in range(0, len(events), 13)]
    for k, part in enumerate(parts):
        log.write(spark.createDataFrame(part + (parts[k - 1][:2] if k else []), EVENT), k)
        if k == 4:
            log.write(spark.createDataFrame(part, EVENT), k)  # replayed
    want = plain_fold(events)
    places = set()
    for opened in range(len(parts)):
        snapshot, deltas, at = log.open(upto=opened)
        places.add(at)
        assert at <= opened and {r["batch"] for r in deltas.select("batch").collect()} == set(range(at + 1, len(parts)))
        assert state(document_state(snapshot.union(deltas.drop("batch")))) == want
    assert places == {-1, 2, 5} and state(document_state(log.events())) == want


def test_results_are_written_once(spark, tmp_path):
    schema = "doc long, at int, text string"
    store = ResultStore(spark, str(tmp_path / "store"), schema, "doc", "at")
    assert not store.read().collect() and not store.commits().collect()
    first = [(1, 1, "a"), (2, 1, "b"), (2, 2, "c")]
    second = [(1, 3, "d"), (3, 1, "e"), (2, 1, "old")]
    store.write(spark.createDataFrame(first, schema), 0)
    broken = spark.createDataFrame(second, schema).withColumn("text", F.when(F.col("doc") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.write(broken, 1)
    before = sorted(map(tuple, store.read().collect()))
    assert before == [(1, 1, "a"), (2, 2, "c")] and store.batches() == [0]
    for _ in range(2):
        store.write(spark.createDataFrame(second, schema), 1)
    assert sorted(map(tuple, store.read().collect())) == [(1, 3, "d"), (2, 2, "c"), (3, 1, "e")]
    assert [(r["batch"], r["rows"], r["keys"]) for r in store.commits().orderBy("batch").collect()] == [(0, 2, 2), (1, 3, 3)]
    assert store.rows().count() == 5
