from collections import Counter

import pytest
from corpus import CASES, CATS, Q, data, one, two
from pyspark.sql import functions as F

from graphlog import union
from graphlog.fold import fold_bytes
from graphlog.sources.log import LogDataSource
from graphlog.streaming import logs, windows


def run(spark, folder, state, out):
    q = logs.route(logs.events(spark.readStream.format("graphlog-stream").load(str(folder))), str(out), str(state)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def counts(spark, out):
    return Counter({r.kind: r["count"] for r in spark.read.parquet(str(out)).groupBy("kind").count().collect()})


BOTH = ("13-position-constraint", "03-unknown-codec", "04-damaged-frame", "22-inline-blob", "12-conflicting-reifier", "26-streamable-lie", "28e-forward-term-reference", "09-suppression")


def test_stream_is_the_batch(spark, tmp_path):
    spark.dataSource.register(logs.LogStream)
    folder, state, out = tmp_path / "in", tmp_path / "state", tmp_path / "out"
    folder.mkdir()
    whole = one() + two()
    cut = len(whole) - 40
    (folder / "a").write_bytes(whole[:cut])
    for case in BOTH:
        (folder / case).write_bytes(CASES[case]())
    run(spark, folder, state, out)
    assert logs.offsets(str(state))[str(folder / "a")] < cut  # the torn frame isn't there yet
    with open(folder / "a", "ab") as f:
        f.write(whole[cut:] + data(("terms", CATS), ("quads", [Q])))
    run(spark, folder, state, out)
    got = counts(spark, out)
    g = fold_bytes(spark, {p.name: p.read_bytes() for p in folder.iterdir()})
    assert got["term"] == g.terms.count()
    assert got["quad"] == g.quads.count()
    assert got["blob"] == g.blobs.count()
    assert got["opaque"] == g.opaque.count()
    assert got["segment-start"] == g.segments.count()
    code = spark.read.parquet(str(out)).filter("kind = 'diagnostic'").select("path", F.element_at("texts", 1).alias("code")).collect()
    want = Counter((r.path, r.code) for r in g.diagnostics.collect())
    assert Counter((r.path.rsplit("/", 1)[-1], r.code) for r in code) == want
    assert {"ConflictingReifier", "ForwardReference", "StreamableLayoutError", "PositionConstraint"} <= {c for _, c in want}
    assert got["reifier"] == g.reifiers.count()
    assert union.value_quads(g).count() == 6


def test_source_format(spark, tmp_path):
    spark.dataSource.register(LogDataSource)
    (tmp_path / "x").write_bytes(one())
    assert spark.read.format("graphlog").load(str(tmp_path)).count() == 3


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions"])
def test_windows_stream_like_batch(spark, tmp_path, name):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=k * 7 % 300), k % 3) for k in range(120)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int")
    events.repartition(3).write.parquet(str(tmp_path / "e"))

    def query(df):
        n = F.count("*").alias("n")
        return {"tumbling": lambda: windows.tumbling(df, "30 minutes", ["user_id"], n), "sliding": lambda: windows.sliding(df, "30 minutes", "10 minutes", [], n), "sessions": lambda: windows.sessions(df, "15 minutes", ["user_id"])}[name]()

    stream = query(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName(f"w_{name}").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert Counter(map(tuple, spark.table(f"w_{name}").collect())) == Counter(map(tuple, query(events).collect()))


def test_an_item_larger_than_a_batch(tmp_path):
    whole = data(("terms", CATS), ("quads", [Q]))
    (tmp_path / "a").write_bytes(whole)
    at, steps = 0, 0
    while at < len(whole):
        after = logs.whole_items(str(tmp_path / "a"), at, 8)
        assert after > at
        at, steps = after, steps + 1
    assert at == len(whole) and steps > 1
    (tmp_path / "a").write_bytes(whole[:-3])
    torn = logs.whole_items(str(tmp_path / "a"), 0, 1 << 20)
    assert logs.whole_items(str(tmp_path / "a"), torn, 8) == torn < len(whole)
