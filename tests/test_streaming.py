import random

import pytest
from pyspark.sql import functions as F

from kerbline.streaming import merged, overlay

SCHEMA = "event_id long, ts timestamp, incident_id long, event_type string"


def records(spark, n=200):
    rng = random.Random(6)
    rows = [(i, 1_700_000_000 + rng.randrange(500), rng.randrange(20), rng.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, s long, incident_id long, event_type string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "incident_id", "event_type"
    )


def test_replay_in_batches_equals_batch_result(spark, tmp_path):
    df = records(spark)
    landed, root, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.repartition(6).write.parquet(landed)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(landed)
        overlay.start_overlay(stream, root, state, "incident_id", ["ts", "event_id"]).awaitTermination()
        return {tuple(r) for r in overlay.current(spark, root).select(df.columns).collect()}

    want = {tuple(r) for r in overlay.latest_per_key(df, "incident_id", ["ts", "event_id"]).collect()}
    assert run() == want
    late = records(spark, 260).where("event_id >= 200")
    late.coalesce(1).write.mode("append").parquet(landed)
    both = df.unionByName(late)
    want = {tuple(r) for r in overlay.latest_per_key(both, "incident_id", ["ts", "event_id"]).collect()}
    assert run() == want


def test_repeated_batch_changes_nothing(spark, tmp_path):
    df, root = records(spark), str(tmp_path / "v")
    write = overlay.merge_batches(root, "incident_id", ["ts", "event_id"])
    write(df.where("event_id < 100"), 0)
    write(df.where("event_id >= 100"), 1)
    once = {tuple(r) for r in overlay.current(spark, root).collect()}
    write(df.where("event_id >= 100"), 1)
    assert {tuple(r) for r in overlay.current(spark, root).collect()} == once
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["v=1", "v=2"]


def test_half_written_version_is_not_served(spark, tmp_path):
    df, root = records(spark), str(tmp_path / "v")
    write = overlay.merge_batches(root, "incident_id", ["ts", "event_id"])
    write(df, 0)
    want = {tuple(r) for r in overlay.current(spark, root).collect()}
    df.limit(1).coalesce(1).write.parquet(f"{root}/v=1")
    (tmp_path / "v" / "v=1" / "_SUCCESS").unlink()
    assert {tuple(r) for r in overlay.current(spark, root).collect()} == want
    write(df.where("event_id < 3"), 1)
    assert {tuple(r) for r in overlay.current(spark, root).collect()} == want


def test_fresh_checkpoint_goes_on_from_the_stored_snapshot(spark, tmp_path):
    df, root = records(spark), str(tmp_path / "v")
    for part, condition in enumerate(("event_id < 100", "event_id >= 100")):
        landed = str(tmp_path / f"in{part}")
        df.where(condition).coalesce(1).write.parquet(landed)
        stream = spark.readStream.schema(df.schema).parquet(landed)
        overlay.start_overlay(stream, root, str(tmp_path / f"state{part}"), "incident_id", ["ts", "event_id"]).awaitTermination()
    want = {tuple(r) for r in overlay.latest_per_key(df, "incident_id", ["ts", "event_id"]).collect()}
    assert {tuple(r) for r in overlay.current(spark, root).select(df.columns).collect()} == want


def test_redelivered_records_are_dropped(spark, tmp_path):
    df = records(spark, 50)
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.unionByName(df.where("event_id % 3 = 0")).coalesce(1).write.parquet(landed)
    stream = spark.readStream.schema(df.schema).parquet(landed)
    clean = overlay.without_redelivery(stream, ["event_id"], "ts", "1 hour")
    q = clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.event_id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == list(range(50))


def test_empty_snapshot_is_valid_and_overwrites(spark, tmp_path):
    path = str(tmp_path / "snap")
    overlay.write_snapshot(records(spark), path)
    overlay.write_snapshot(records(spark).limit(0), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 0 and "incident_id" in stored.columns
    assert overlay.overlay_counts(stored, "event_type", "event_type").count() == 0
    assert overlay.current(spark, str(tmp_path / "none")) is None


def stamped(spark, rows):
    """(event_id, seconds, incident_id, end in seconds, pull)"""
    df = spark.createDataFrame(rows, "event_id long, s long, incident_id long, e long, pull int")
    return df.select("event_id", F.timestamp_seconds("s").alias("ts"), "incident_id", F.timestamp_seconds("e").alias("ended"), "pull")


ORDER = ["ts", "event_id"]


def served(spark, root):
    return {r.incident_id: r.event_id for r in overlay.current(spark, root).collect()}


@pytest.mark.parametrize("deltas", [2, 3, 100])
def test_merge_on_read_with_ends_equals_replay(spark, tmp_path, deltas):
    rng, root = random.Random(deltas), str(tmp_path / "m")
    write = merged.merge_deltas(root, "incident_id", ORDER, "ts", "ended", retain_s=1000.0, buckets=3, deltas=deltas)
    sent, newest, event = {}, 0, 0
    for number in range(9):
        rows = []
        for _ in range(30):
            s = 10_000 + 100 * number + rng.randrange(-900, 100)
            rows.append((event, s, rng.randrange(25), rng.choice([None, s + 50, s + 5000]), 0))
            event += 1
        again = rng.sample(list(sent.values()), 5) if sent else []
        write(stamped(spark, rows + again), number)
        for r in rows + again:
            if not sent or r[1] >= newest - 1000:  # others come too late
                key = (r[1], r[0])
                if r[2] not in sent or key > (sent[r[2]][1], sent[r[2]][0]):
                    sent[r[2]] = r
        newest = max([newest, *(r[1] for r in rows)])
        want = {i: r[0] for i, r in sent.items() if r[3] is None or r[3] > newest}
        assert served(spark, root) == want
    write(stamped(spark, rows), 8)
    assert served(spark, root) == want


def test_late_record_of_an_ended_incident_does_not_revive_it(spark, tmp_path):
    root = str(tmp_path / "m")
    write = merged.merge_deltas(root, "incident_id", ORDER, "ts", "ended", buckets=2, deltas=2)
    write(stamped(spark, [(1, 100, 7, None, 0), (2, 100, 8, None, 0)]), 0)
    write(stamped(spark, [(3, 300, 7, 300, 0)]), 1)
    assert served(spark, root) == {8: 2}
    for number in range(2, 7):
        write(stamped(spark, [(4, 200, 7, None, 0)]), number)
        assert served(spark, root) == {8: 2}
    write(stamped(spark, [(9, 400, 7, None, 0)]), 7)
    assert served(spark, root) == {7: 9, 8: 2}


def test_incidents_absent_from_the_newest_pull_leave(spark, tmp_path):
    root = str(tmp_path / "m")
    write = merged.merge_deltas(root, "incident_id", ORDER, "ts", pull="pull", buckets=2, deltas=2)
    write(stamped(spark, [(1, 10, 1, None, 9), (2, 10, 2, None, 9)]), 0)
    assert served(spark, root) == {1: 1, 2: 2}
    write(stamped(spark, [(3, 20, 2, None, 10), (4, 20, 3, None, 10)]), 1)
    assert served(spark, root) == {2: 3, 3: 4}
    # The older pull once more, late.
    write(stamped(spark, [(1, 10, 1, None, 9), (2, 10, 2, None, 9)]), 2)
    assert served(spark, root) == {2: 3, 3: 4}


def test_a_batch_writes_in_proportion_and_readers_keep_their_version(spark, tmp_path):
    root = str(tmp_path / "m")
    write = merged.merge_deltas(root, "incident_id", ORDER, buckets=4, deltas=3)
    first = spark.range(40_000).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "id as incident_id", "uuid() as event_type")
    data = lambda: {p: p.stat().st_size for p in (tmp_path / "m" / "data").rglob("*.parquet")}
    write(first, 0)
    base = sum(data().values())
    held, most, total = None, 0, 0
    for number in range(1, 9):
        before = data()
        batch = spark.range(40).selectExpr(f"id + {100_000 * number} as event_id", f"timestamp_seconds({100_000 * number} + id) as ts", "id * 7 as incident_id", "uuid() as event_type")
        write(batch, number)
        new = sum(size for p, size in data().items() if p not in before)
        most, total = max(most, new), total + new
        if number == 2:
            held = overlay.current(spark, root)
            want = {tuple(r) for r in held.collect()}
        if number == 4:  # compaction has run since
            assert {tuple(r) for r in held.collect()} == want
    assert most < 0.05 * base
    assert overlay.current(spark, root).count() == 40_000
    assert overlay.current(spark, root).where("event_id >= 800000").count() == 40


def test_second_writer_is_refused_and_an_empty_batch_is_a_version(spark, tmp_path):
    root = str(tmp_path / "m")
    write = merged.merge_deltas(root, "incident_id", ORDER)
    write(records(spark).limit(0), 0)
    assert overlay.current(spark, root).count() == 0 and "incident_id" in overlay.current(spark, root).columns
    store = merged._Store(spark, root)
    with pytest.raises(RuntimeError):
        store.commit(store.newest())
    with pytest.raises(ValueError):
        merged.merge_deltas(root, "incident_id", ORDER, end="ended")
