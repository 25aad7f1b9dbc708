"""Rules of the change log and of streams that refuse what they must not lose."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricetrail.functions.text import strip_accents
from pricetrail.operators import changes as C
from pricetrail.operators.runs import latest_runs
from pricetrail.schemas import CHANGES
from pricetrail.sources.sinks import publish
from pricetrail.sources.tables import read_changes
from pricetrail.streaming import feeds as W

EVENT = "kind string, entity_id string, payload string"


def batch(frame, *ids):
    return frame(EVENT, [("product", i, '{"v": 1}') for i in ids])


def test_log_follows_its_head(spark, frame, tmp_path):
    log = str(tmp_path / "log")
    publish(batch(frame, "a", "b"), 0, log)
    publish(batch(frame, "c"), 2, log)
    publish(batch(frame, "c"), 2, log)  # the last batch again, after a failure
    for base, ids in ((0, ["a", "b"]), (2, ["d"]), (10, ["e"]), (1, ["e"])):
        with pytest.raises(ValueError):
            publish(batch(frame, *ids), base, log)
    publish(batch(frame, "d"), 3, log)
    rows = read_changes(spark, log)
    assert rows.columns == StructType.fromDDL(CHANGES).fieldNames()
    assert sorted((r.version, r.entity_id) for r in rows.collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_unknown_kind_stops_the_stream(spark, frame, tmp_path):
    frame("version long, kind string, entity_id string, payload string", [(1, "product", "a", "{}"), (2, "voucher", "v", "{}")]).write.parquet(str(tmp_path / "in"))
    live = read_changes(spark, str(tmp_path / "in"), stream=True)
    query = W.stream_replica(live, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    with pytest.raises(Exception, match="unknown kind of change: voucher"):
        query.awaitTermination()


@pytest.mark.parametrize("pages, decision", [
    ([(None, 5, False), (5, 9, False), (9, None, True)], "advance"), ([(None, None, True)], "advance"),
    ([(None, 5, False), (9, None, True)], "incomplete"), ([(5, 9, False), (9, None, True)], "incomplete"),
    ([(None, 5, False), (5, 9, False)], "incomplete"), ([(None, 5, False), (5, 9, False), (5, 9, False), (9, None, True)], "incomplete"),
    ([(None, 5, False), (5, 5, False), (5, None, True)], "incomplete"),
])
def test_watermark_needs_every_page(frame, pages, decision):
    rows = frame("cursor long, next_cursor long, last boolean, server_version long, generation string", [(*p, 12, "g") for p in pages])
    state = frame("generation string, version long", [("g", 3)])
    assert C.advance(state, rows).first().decision == decision


def test_deep_levels_keep_their_digits_and_order(frame):
    rows = frame("kind string, level string, id string", [("category", str(n), "x") for n in (0, 7, 99_999, 100_000, 123_456, 1_000_000)])
    keys = [r[0] for r in rows.select(C.snapshot_key(F.col("kind"), F.col("level"), F.col("id")), F.col("level").cast("int").alias("n")).orderBy("n").collect()]
    assert keys == sorted(keys) and len(set(keys)) == 6 and keys[1] == "0:00007:x"


def test_accents_of_every_script(frame):
    rows = frame("t string", [("Й Ё ά ΐ é ș Ǆ",)])
    assert rows.select(strip_accents(F.col("t"))).first()[0] == "и е α ι e s ǆ"


def test_a_finished_run_replaces_its_running_image(frame):
    ddl = "source string, id long, scope string, started_at timestamp, status string, source_error string, price_refresh_complete boolean"
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [("s", 1, "full", at, "complete", None, True), ("s", 1, "full", at, "running", None, False)]
    for order in (rows, rows[::-1]):
        assert latest_runs(frame(ddl, order)).first()["attempt"]["status"] == "complete"
