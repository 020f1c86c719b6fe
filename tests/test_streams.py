"""Streams give what the batch forms give."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from figweave.operators.metrics import rolling
from figweave.streaming import streams as S


def test_folder_batches_resume(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    for k in range(4):
        (src / f"{k}.json").write_text(json.dumps({"k": k}))
    seen = []
    run = lambda: S.folder_batches(spark, str(src), "k int", lambda df, n: seen.append(sorted(r.k for r in df.collect())), ck)
    run()
    assert sorted(sum(seen, [])) == [0, 1, 2, 3] and max(map(len, seen)) == 3
    (src / "4.json").write_text(json.dumps({"k": 4}))
    run()
    assert sorted(sum(seen, [])) == [0, 1, 2, 3, 4]


def _stream(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_molecule_history_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"C{i % 7}",) for i in range(50)], "smiles string")
    _run(S.new_molecules(_stream(spark, rows, tmp_path / "m")), "mols", "append")
    assert sorted(r.smiles for r in spark.table("mols").collect()) == sorted(r.smiles for r in rows.distinct().collect())


def test_running_means_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    _run(S.running_means(_stream(spark, events, tmp_path / "e"), delay="100 days"), "means", "complete")
    want = {(r.event_type, r.start): (r.n, round(r.mean, 9)) for r in S.running_means(events).collect()}
    assert {(r.event_type, r.start): (r.n, round(r["mean"], 9)) for r in spark.table("means").collect()} == want


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old)


EVENT = "event_id long, event_type string, ts timestamp, value double"


def _events(spark, rows):
    from datetime import datetime, timedelta, timezone

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return spark.createDataFrame([(i, k, start + timedelta(hours=h), v) for i, k, h, v in rows], EVENT)


def test_last_values_equal_batch_over_a_restart(spark, sf, tmp_path, rocks):
    """One folder a batch, the query stopped between them; the last numbers of each key are those of the batch form."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value").filter("value is not null")
    places = events.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (1, 2, 3):
        places.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(src)
        stream = S.last_values(spark.readStream.schema(events.schema).parquet(src), keep="9000 days", delay="9000 days")
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_type: r for r in spark.read.parquet(out).groupBy("event_type").agg(F.max_by(F.struct("n", "median", "mean", "max"), "n").alias("r")).select("event_type", "r.*").collect()}
    last = rolling(events, "event_type", ["ts", "event_id"], "value", 20).groupBy("event_type").agg(F.max_by(F.struct("median", "mean", "max"), F.struct("ts", "event_id")).alias("r"), F.count("*").alias("n")).select("event_type", "n", "r.*").collect()
    assert len(last) == len(got) > 1
    for r in last:
        assert got[r.event_type].n == r.n and got[r.event_type]["median"] == r["median"] and abs(got[r.event_type]["mean"] - r["mean"]) < 1e-9 and got[r.event_type]["max"] == r["max"]


def test_keys_that_stop_end(spark, tmp_path, rocks):
    """Key b has no row for two days: it is closed with its last numbers and starts anew later."""
    src, out = str(tmp_path / "src"), []
    batches = [[(1, "a", 0, 1.0), (2, "b", 1, 5.0), (3, "b", 2, 7.0)], [(4, "a", 90, 2.0)], [(5, "a", 91, 3.0), (6, "b", 92, 9.0)]]
    for k, rows in enumerate(batches):
        _events(spark, rows).coalesce(1).write.mode("append").parquet(src)
        stream = S.last_values(spark.readStream.schema(EVENT).parquet(src), keep="2 days", delay="1 hour")
        write = lambda df, n: out.extend((k, r.event_type, r.n, r.mean, r.closed) for r in df.collect())  # noqa: E731, B023
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert (1, "b", 2, 6.0, True) in out or (2, "b", 2, 6.0, True) in out
    assert [(n, mean) for _, key, n, mean, closed in out if key == "b" and not closed][-1] == (1, 9.0)
    assert sum(closed for *_, closed in out if closed) == len([x for x in out if x[-1]])


def test_two_sinks_agree_after_a_crash_between_them(spark, tmp_path):
    src, root, ck = (str(tmp_path / x) for x in ("src", "root", "ck"))
    spark.createDataFrame([(i, str(i) if i % 3 else "bad") for i in range(30)], "id int, v string").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("id int, v string").option("maxFilesPerTrigger", 1).parquet(src)
    state = {"fail": True}

    def split(batch):
        good, bad = batch.withColumn("n", F.col("v").try_cast("int")), batch.filter(F.col("v").try_cast("int").isNull())
        frames = {"good": good.filter("n is not null"), "bad": bad}

        class Failing(dict):
            def items(self):
                yield "good", self["good"]
                if state["fail"] and spark.sparkContext is not None and len(seen) == 1:
                    raise RuntimeError("between the two writes")
                seen.append(1)
                yield "bad", self["bad"]

        return Failing(frames)

    seen = []
    with pytest.raises(Exception, match="between the two writes"):
        S.two_sinks(stream, split, root, ck)
    ids = lambda name: sorted(r.id for r in S.read_done(spark, root, name).collect())
    first = {r.batch for r in S.read_done(spark, root, "good").collect()}
    assert first == {0} and {r.batch for r in S.read_done(spark, root, "bad").collect()} <= {0}
    state["fail"] = False
    S.two_sinks(stream, split, root, ck)
    assert ids("good") == [i for i in range(30) if i % 3] and ids("bad") == [i for i in range(30) if i % 3 == 0]


def test_history_across_runs(spark, tmp_path):
    src, history, ck = (str(tmp_path / x) for x in ("src", "history", "ck"))
    rows = lambda a, b: spark.createDataFrame([(f"C{i % 9}",) for i in range(a, b)], "smiles string").repartition(2)
    for a, b in ((0, 5), (3, 40)):
        rows(a, b).write.mode("append").parquet(src)
        S.molecules_new_to(history, spark.readStream.schema("smiles string").option("maxFilesPerTrigger", 1).parquet(src), ck)
    assert sorted(r.smiles for r in spark.read.parquet(history).collect()) == [f"C{i}" for i in range(9)]
