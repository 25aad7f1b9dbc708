"""Streams over several micro-batches with replays and restarts, folded into generations while they run."""

import random

import pytest
from pyspark.sql import functions as F

from pricetrail.operators.changes import snapshot
from pricetrail.operators.observations import absence_streak
from pricetrail.schemas import CHANGES
from pricetrail.sources.manifest import Part, Store
from pricetrail.sources.tables import read_changes
from pricetrail.streaming import feeds as W

EVENT = "id string, run long, closing boolean"


def image(df):
    return sorted((r.kind, r.entity_id, r.version, r.payload) for r in df.collect())


def test_batches_are_folded_in_place(spark, frame, tmp_path):
    rows = [(v, "product", str(v % 5), f'{{"n": {v}}}') for v in range(1, 41)]
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for k in range(8):
        frame(CHANGES, rows[5 * k : 5 * k + 5]).coalesce(1).write.mode("append").parquet(log)
    kind = read_changes(spark, log, True, 1)
    W._write_batches(snapshot(kind), out, str(tmp_path / "cp"), True, snapshot, every=3).awaitTermination()
    assert len(Store(spark, out).read().parts) <= 4
    assert image(W.read_replica(spark, out)) == image(snapshot(frame(CHANGES, rows)))
    W.compact_replica(spark, out)
    assert len(Store(spark, out).read().parts) == 1


def test_a_reader_is_pinned_to_its_manifest(spark, frame, tmp_path):
    out, store = str(tmp_path), Store(spark, str(tmp_path))

    def arrive(k, rows):
        name = store.write(frame("kind string, entity_id string, version long, payload string", rows), "batch")
        store.update(lambda m: {"parts": (*m.parts, Part(name, k, k, 0))})

    arrive(0, [("product", "a", 1, "x")])
    arrive(1, [("product", "b", 2, "x")])
    pinned = store.read()
    before = image(W.read_replica(spark, out, pinned))
    real = store.write

    def slow(folded):  # a batch arrives while the batches are being folded
        arrive(2, [("product", "a", 3, "y")])
        return snapshot(folded)

    W.fold_batches(spark, out, slow)
    now = store.read()
    assert len(now.parts) == 2 and now.generation != pinned.generation and store.write == real
    assert image(W.read_replica(spark, out, pinned)) == before
    assert image(W.read_replica(spark, out)) == [("product", "a", 3, "y"), ("product", "b", 2, "x")]
    with pytest.raises(ValueError):
        W.read_replica(spark, str(tmp_path / "none"))


def test_a_repeated_batch_counts_once(spark, frame, tmp_path):
    log, out, cp = (str(tmp_path / n) for n in ("log", "out", "cp"))
    frame(EVENT, [("a", 1, False), ("a", 1, True), ("b", 1, True)]).coalesce(1).write.parquet(log)
    live = lambda: spark.readStream.schema(EVENT).parquet(log)
    W.stream_absences(live(), out, cp, once=True).awaitTermination()
    first = Store(spark, out).read()
    W.stream_absences(live(), out, str(tmp_path / "other"), once=True).awaitTermination()  # batch 0 once more, as after a lost commit
    assert Store(spark, out).read().parts == first.parts


def by_definition(events):
    counters, closed = {}, {}
    seen = {(i, r) for i, r, c in events if not c}
    for i, r in sorted({(i, r) for i, r, c in events if c}, key=lambda x: x[1]):
        counters[i] = 0 if (i, r) in seen else counters.get(i, 0) + 1
        closed[i] = r
    return sorted((i, closed[i], n, n >= 1, n >= 3) for i, n in counters.items())


def test_counter_equals_batch_over_batches_replay_and_restart(spark, frame, tmp_path):
    pick, log = random.Random(4), str(tmp_path / "log")
    ids, runs = [f"p{i}" for i in range(12)], 9
    sightings = [(i, r) for i in ids for r in range(1, runs + 1) if pick.random() < 0.3]
    by_run = {r: [(i, r, False) for i, x in sightings if x == r] * 2 + [(i, r, True) for i in ids] for r in range(1, runs + 1)}
    run = lambda: W.stream_absences(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(log),
                                    str(tmp_path / "out"), str(tmp_path / "cp"), once=True, every=3).awaitTermination()
    for r in (1, 2, 3, 2, 4, 5, 6, 7, 6, 8, 9):  # some runs arrive twice
        frame(EVENT, by_run[r]).coalesce(1).write.mode("append").parquet(log)
        if r in (3, 7):
            run()  # and then the stream starts again from its checkpoint
    run()
    got = sorted(map(tuple, W.read_absences(spark, str(tmp_path / "out")).collect()))
    assert got == by_definition([e for events in by_run.values() for e in events])
    batch = absence_streak(frame("id string, run long", sightings), frame("id string", [(i,) for i in ids]), runs).filter(F.col("run") == runs)
    assert got == sorted((r.id, r.run, r.missing_count, r.possibly_inactive, r.inactive) for r in batch.collect())


def test_a_late_sighting_resets_its_run(spark, frame, tmp_path):
    log = str(tmp_path / "log")
    run = lambda: W.stream_absences(spark.readStream.schema(EVENT).parquet(log), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    for events in ([("a", 1, True), ("a", 2, True)], [("a", 2, False)]):
        frame(EVENT, events).coalesce(1).write.mode("append").parquet(log)
        run()
    assert [tuple(r) for r in W.read_absences(spark, str(tmp_path / "out")).collect()] == [("a", 2, 0, False, False)]


def test_absence_counters_by_definition(spark):
    """Batches put together per product give what one event after the other gives."""
    pick, products = random.Random(7), {}
    written, want = None, {}
    for _ in range(4):
        events = [(f"p{pick.randrange(60)}", pick.randint(1, 9), pick.random() < 0.6) for _ in range(150)]
        for name in {e[0] for e in events}:
            closed, seen, missing = products.get(name, (0, 0, 0))
            for run, closing in sorted({e[1:] for e in events if e[0] == name}):
                if not closing:
                    seen = max(seen, run)
                    missing = 0 if run >= closed else missing
                if closing and run > closed:
                    closed, missing = run, 0 if seen >= run else missing + 1
                if run == closed and (closing or missing == 0) and (name not in want or (run, -missing) >= (want[name][0], -want[name][1])):
                    want[name] = (run, missing)
            products[name] = (closed, seen, missing)
        rows = W._counted(spark.createDataFrame(events, "id string, run long, closing boolean"), written).localCheckpoint()
        written = rows if written is None else written.unionByName(rows)
    got = {r["id"]: (r["run"], r["missing_count"]) for r in W._newest_counter(written).filter("run > 0").collect()}
    assert got == want and max(m for _, m in want.values()) >= 3
