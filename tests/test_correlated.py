"""The interval join of errors and purchases over several batches, against plain loops."""

import math
from datetime import datetime, timedelta
from pathlib import Path

from starloom.sources.storage import shared_dir
from starloom.streaming import observations as Z


def place(event_id, user_id):
    return (user_id * 37) % 100 / 10.0 + 42.0 + (event_id % 7) / 100.0, (user_id * 53) % 120 / 10.0 + (event_id % 11) / 100.0


def km(a, b):
    (lat1, lon1), (lat2, lon2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_pairs_meet_across_batches_and_in_no_state_store(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 1, 12)
    rows = [(i, at + timedelta(seconds=150 * i), i % 13, ("error", "purchase", "click")[i % 3], 1.0, None) for i in range(80)]
    rows += [(100, at, 1, "error", 1.0, None), (101, at + timedelta(minutes=15), 2, "purchase", 1.0, None), (102, at + timedelta(minutes=15, microseconds=1), 2, "purchase", 1.0, None), (103, None, 2, "purchase", 1.0, None)]
    for n, part in enumerate((rows[:40], rows[40:80], rows[80:])):
        made = tmp_path / f"made{n}"
        spark.createDataFrame(part, Z.SCHEMA).coalesce(1).write.parquet(str(made))
        next(made.glob("part-*.parquet")).rename(tmp_path / f"events{n}.parquet")
    one_by_one = lambda s, d: s.readStream.schema(Z.SCHEMA).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 1).parquet(d).withColumn("ts", Z.F.col("ts").cast("timestamp"))

    def pairs(kept):
        return sorted((a[0], b[0]) for a in kept for b in kept if a[3] == "error" and b[3] == "purchase" and a[1] and b[1] and a[2] != b[2] and abs(a[1] - b[1]) <= timedelta(minutes=15) and km(place(a[0], a[2]), place(b[0], b[2])) <= Z.RADIUS_KM)

    assert sorted(map(tuple, Z.correlated(spark, str(tmp_path)).collect())) == pairs(rows)
    # a file a batch: the third comes later than rows may come, so what it meets of the batches before may be gone
    monkeypatch.setattr(Z, "event_stream", one_by_one)
    got = sorted(map(tuple, Z.correlated(spark, str(tmp_path)).collect()))
    assert len(set(got)) == len(got) and set(got) <= set(pairs(rows)) and set(pairs(rows[:80])) | set(pairs(rows[80:])) <= set(got)
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("correlated-state*/state"))


def test_no_events_give_no_pairs(spark, tmp_path):
    assert Z.correlated(spark, str(tmp_path)).collect() == []
