"""Turns, first rows and last writers over streams, against their batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from skeinworks.operators import masking
from skeinworks.session import table
from skeinworks.streaming import keyed
from tests.conftest import SMALL

START = datetime.datetime(2024, 1, 1)
#: A row of its own key, long after all others: it moves the watermark past them.
TICK = -1
#: A session of null is one like others.
NO_SESSION = [(None, p, "assistant", f"n{p}") for p in range(3)]


def run(spark, tmp_path, batches, schema, stream):
    """What a stream makes of the batches, each one file, and a last one that lets all expire."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:02d}"))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        keyed.started(stream(source), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("keep", [1, 2])
def test_turns_equal_batch(spark, tmp_path, keep):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(900 + k, p, "user" if p % 2 == 0 else "assistant", f"line\n{p}\n" * 4) for k in range(3) for p in range(14)] + NO_SESSION
    rnd = random.Random(keep)
    timed = [(*r, at(rnd.randint(0, 5))) for r in rows]
    rnd.shuffle(timed)
    n = len(timed) // 3
    batches = [timed[:n], timed[n : 2 * n] + timed[:5], timed[2 * n :], [(TICK, 0, "user", "", at(1000))]]
    schema = "conv_id long, turn long, role string, text string, at timestamp"
    closes = F.col("role") == "assistant"
    got = run(spark, tmp_path, batches, schema, lambda s: keyed.rolling_turns(s, "conv_id", "turn", "at", closes, keep, late="30 minutes"))
    want = masking.outside_window(masking.turns(spark.createDataFrame(timed, schema), "conv_id", "turn", closes), "conv_id", keep)
    columns = ["conv_id", "turn", "role", "text", "at", "turn_id", "stale"]
    plain = lambda rows: sorted(map(tuple, rows), key=str)
    assert plain(got.where(~F.col("conv_id").eqNullSafe(TICK)).select(columns).collect()) == plain(want.select(columns).collect())


def test_turns_with_gaps_and_after_idle(spark, tmp_path):
    """A gap holds messages back until the session is idle; later messages begin anew."""
    message = lambda pos, minute: (1, pos, "assistant", f"m{pos}", at(minute))
    batches = [[message(0, 0), message(2, 1), message(3, 1)], [(TICK, 0, "user", "", at(1000))], [message(0, 1001)], [(TICK, 1, "user", "", at(3000))]]
    schema = "conv_id long, turn long, role string, text string, at timestamp"
    got = run(spark, tmp_path, batches, schema, lambda s: keyed.rolling_turns(s, "conv_id", "turn", "at", F.lit(True), 1))
    assert sorted((r.turn, r.turn_id, r.stale, r.at) for r in got.where("conv_id = 1").collect()) == [(0, 0, False, at(1001)), (0, 0, True, at(0)), (2, 1, True, at(1)), (3, 2, False, at(1))]


def test_last_writer_late_repeated_deleted(spark, tmp_path):
    schema = "path string, content string, seq long, at timestamp"
    batches = [
        [("a", "one", 1, at(0)), ("a", "two", 2, at(0)), ("b", "x", 1, at(0)), ("c", "y", 5, at(1))],
        [("a", "two", 2, at(1)), ("b", None, 3, at(1)), ("c", "late", 4, at(1))],  # repeated, deleted, late
        [("b", "older", 2, at(2)), ("a", "three", 7, at(2)), ("b", "again", 4, at(2))],
    ]
    got = run(spark, tmp_path, batches, schema, lambda s: keyed.last_writer(s, F.col("path"), "seq", "at"))
    assert sorted((r.path, r.seq, r.content) for r in got.collect()) == [("a", 2, "two"), ("a", 7, "three"), ("b", 1, "x"), ("b", 3, None), ("b", 4, "again"), ("c", 5, "y")]


def test_first_seen_and_expiry(spark, tmp_path):
    schema = "key string, seq long, at timestamp"
    batches = [[("a", 3, at(0)), ("a", 2, at(0)), ("b", 4, at(0))], [("a", 1, at(1)), ("c", 9, at(1))], [("tick", 0, at(5000))], [("a", 8, at(5001))]]
    got = run(spark, tmp_path, batches, schema, lambda s: keyed.first_seen(s, F.lower("key"), "seq", "at", keep="60 minutes"))
    assert sorted((r.key, r.seq) for r in got.collect()) == [("a", 2), ("a", 8), ("b", 4), ("c", 9), ("tick", 0)]
