"""Publication: what readers and competing publishers see."""

import threading

import pytest
from pyspark.sql import functions as F

from starloom.sources.publication import Published, Superseded, Unverified, Version
from starloom.sources.storage import scratch

SCHEMA = "generation long, tile long"


def rows(spark, generation, n=50):
    return spark.range(n).select(F.lit(generation).cast("long").alias("generation"), F.col("id").alias("tile"))


@pytest.fixture
def place(spark):
    return Published(spark, scratch(spark, "published"))


def test_nothing_is_published_at_first(spark, place):
    schema = rows(spark, 1).schema
    assert place.version() == Version(0) and place.read(schema).count() == 0


def test_versions_follow_one_another(spark, place):
    schema = rows(spark, 1).schema
    for g in (1, 2, 3, 4):
        assert place.publish(rows(spark, g, 10 * g)).number == g
        assert {r.generation for r in place.read(schema).collect()} == {g} and place.version().rows == 10 * g
    assert place.read(schema, 1).count() == 10
    place.prune(2)
    assert place.numbers() == [3, 4] and place.read(schema, 3).count() == 30 and place.read(schema).count() == 40


def test_of_two_activations_one_wins(spark, place):
    place.publish(rows(spark, 1))
    staged = [place.stage(rows(spark, g)) for g in (2, 3)]
    start, outcome = threading.Barrier(2), {}

    def activate(k):
        start.wait()
        try:
            outcome[k] = place.switch(staged[k]).number
        except Superseded:
            outcome[k] = None

    threads = [threading.Thread(target=activate, args=(k,)) for k in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcome.values(), key=str) == [2, None]
    won = next(k for k, v in outcome.items() if v)
    assert {r.generation for r in place.read(rows(spark, 1).schema).collect()} == {won + 2}
    with pytest.raises(Superseded):
        place.switch(staged[1 - won])


def test_readers_never_fail_while_others_publish(spark, place):
    schema = rows(spark, 0).schema
    place.publish(rows(spark, 0))
    stop, seen, failed = threading.Event(), set(), []

    def read():
        while not stop.is_set():
            try:
                got = place.read(schema).groupBy("generation").count().collect()
                assert len(got) == 1 and got[0]["count"] == 50
                seen.add(got[0].generation)
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for g in range(1, 6):
        place.publish(rows(spark, g))
    stop.set()
    reader.join()
    assert not failed and len(seen) > 1


def test_staged_files_are_held_against_what_was_to_be_written(spark, place):
    df = rows(spark, 1)
    staged = place.stage(df)
    with pytest.raises(Unverified):
        place.verify(staged, df.schema, 49)
    place._fs.delete(place._path(staged.folder), True)
    with pytest.raises(Unverified):
        place.verify(staged, df.schema)
    assert place.version().number == 0
