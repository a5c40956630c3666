"""Keyed state over several runs of a stream: every read once, timers, late rows, restarts."""

import json
import os

from pyspark.sql import functions as F

from spanforge.streaming import state

MINUTE = 60_000


class Feed:
    """A stream of JSON files, run file after file from one checkpoint."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.n = spark, folder, schema, make, 0
        (folder / "in").mkdir()

    def run(self, *files):
        """Add files and let a query of its own, from the checkpoint, work on them; what has come out so far, and late rows."""
        for rows in files:
            path = self.folder / "in" / f"{self.n:03}.json"
            path.write_text("\n".join(json.dumps(r) for r in rows))
            # Files are read in order of their times.
            os.utime(path, (1_700_000_000 + self.n, 1_700_000_000 + self.n))
            self.n += 1
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in")).withColumn("t", F.to_timestamp("t"))
        query = self.make(source).writeStream.format("json").option("checkpointLocation", str(self.folder / "check")).option("path", str(self.folder / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
        return sorted(json.loads(x) and tuple(sorted(json.loads(x).items())) for f in (self.folder / "out").glob("*.json") for x in f.read_text().splitlines()), late


def at(minute):
    return f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00"


def test_mates_come_once_and_expire_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "r string, c string, a long, m long, t string", lambda df: state.paired_or_expired(df, "t", "r", "c", "a", "m", 10 * MINUTE, "5 minutes"))
    row = lambda r, a, m, t: {"r": r, "c": "c", "a": a, "m": m, "t": at(t)}
    feed.run([row("pair", 5, 90, 0), row("lone", 5, 90, 0), row("none", 7, None, 0)], [row("pair", 90, 5, 3), row("twice", 1, 2, 3), row("twice", 1, 2, 3), row("twice", 2, 1, 4)])
    # A restart; time goes on far enough for the timers, then a row that is too late.
    got, late = feed.run([row("tick", 1, None, 40)], [row("tick", 2, None, 41)], [row("lone", 90, 5, 1), row("tick", 3, None, 60)], [row("tick", 4, None, 61)])
    assert late >= 1
    found = [(dict(x)["read"], dict(x).get("left"), dict(x).get("mate_left"), dict(x)["status"]) for x in got]
    assert sorted(x for x in found if x[0] != "tick") == [("lone", 5, 90, "SINGLE"), ("none", 7, None, "SINGLE"), ("pair", 5, 90, "PAIR"), ("twice", 1, 2, "PAIR"), ("twice", 1, 2, "SINGLE")]


def test_islands_are_given_out_when_they_close(spark, tmp_path):
    feed = Feed(spark, tmp_path, "g string, lo long, hi long, t string", lambda df: state.closed_islands(df, "t", "g", "lo", "hi", 5, 10 * MINUTE, "5 minutes"))
    row = lambda g, lo, hi, t: {"g": g, "lo": lo, "hi": hi, "t": at(t)}
    feed.run([row("x", 0, 10, 0), row("x", 100, 110, 0), row("y", 0, 4, 0)], [row("x", 50, 101, 2), row("x", 12, 20, 2)])
    got, _ = feed.run([row("z", 0, 1, 40)], [row("z", 0, 1, 41)], [row("x", 15, 30, 60)], [row("z", 0, 1, 100)], [row("z", 0, 1, 101)])
    found = sorted((dict(x)["g"], dict(x)["lo"], dict(x)["hi"], dict(x)["n"]) for x in got)
    assert [x for x in found if x[0] != "z"] == [("x", 0, 20, 2), ("x", 15, 30, 1), ("x", 50, 110, 2), ("y", 0, 4, 1)]
