"""Sources, sinks and streams on files written by the tests."""

import json

import pytest
from pyspark.errors import StreamingQueryException

from siltstone.sources import io
from siltstone.streaming import sketches


def lines(df):
    return [r["value"] for r in df.collect()]


def test_json_and_models(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text("\n".join(json.dumps(x) for x in ({"type": "user", "name": "u", "profile": ["a"]}, {"type": "business", "name": "b", "profile": []})))
    assert [r["name"] for r in io.model_by_type(spark, str(path), "user").collect()] == ["u"]
    io.write_json_lines(io.model_by_type(spark, str(path), "business"), str(tmp_path / "out"))
    assert io.json_lines(spark, str(tmp_path / "out"), "name string").first()["name"] == "b"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u1", "b1"), ("u2", "b2")], "user_id string, business_id string")
    io.write_csv(df, str(tmp_path / "c"))
    io.write_csv(df, str(tmp_path / "c"), append=True)
    assert sorted(map(tuple, io.csv_pairs(spark, str(tmp_path / "c")).collect())) == sorted([("u1", "b1"), ("u2", "b2")] * 2)


def test_vectors_and_stop_words(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "0.txt").write_text("1,0.5,2\n\n")
    (tmp_path / "v" / "1.txt").write_text("2,1,1\n")
    rows = sorted(map(tuple, io.vector_chunks(spark, str(tmp_path / "v")).collect()))
    assert rows == [(1, [0.5, 2.0], "0.txt"), (2, [1.0, 1.0], "1.txt")]
    (tmp_path / "stop").write_text("the\nof")
    assert io.stop_words(spark, str(tmp_path / "stop")) == ["the", "of"]


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "itemset array<string>, size int")
    assert {r["size"]: r["value"] for r in io.itemset_lines(sets).collect()} == {1: "('a'),('b')", 2: "('a', 'b')"}
    groups = spark.createDataFrame([(2, ["b", "c"]), (1, ["z"]), (2, ["a", "d"])], "size int, members array<string>")
    assert lines(io.community_lines(groups)) == ["'z'", "'a', 'd'", "'b', 'c'"]
    found = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 2.5)], "a string, b string, betweenness double")
    assert lines(io.betweenness_lines(found)) == ["('c', 'd'), 2.5", "('a', 'b'), 1.0"]
    hits = spark.createDataFrame([(2, 0), (1, 1), (3, 1)], "n int, hit int")
    assert lines(io.bit_vector_line(hits, "n", "hit")) == ["1 0 1"]
    io.write_answers(spark, {"A": 1}, str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text()) == {"A": 1}
    both = io.itemset_report(sets, sets.where("size = 2")).collect()
    assert [(r["block"], r["value"]) for r in both] == [("Candidates:", "('a'),('b')"), ("Candidates:", "('a', 'b')"), ("Frequent Itemsets:", "('a', 'b')")]


def test_parse_json(spark):
    df = spark.createDataFrame([('{"city": "Graz"}',), ("{}",), (None,)], "value string")
    assert [r["key"] for r in sketches.parse_json(df, "city").collect()] == ["Graz", "", ""]


def test_tagged_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    message = lambda *tags: json.dumps({"entities": {"hashtags": [{"text": t} for t in tags]}})
    (tmp_path / "in" / "m.json").write_text("\n".join([message("x", "y"), message("x"), message(), message("z")]))
    got = []
    tags = sketches.reservoir_tags(io.tagged_stream(spark, str(tmp_path / "in")))
    writer = tags.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect())))
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert got == [(3, "x", 2), (3, "y", 1), (3, "z", 1)]


def test_filters_of_a_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [
        {"text": "The NBA final", "lang": "en", "entities": {"hashtags": [{"text": "final"}]}},
        {"text": "none", "lang": "en", "entities": {"hashtags": [{"text": "nba"}]}},
        {"text": "near", "lang": "en", "coordinates": {"coordinates": [-74.0, 40.8]}, "entities": {"hashtags": [{"text": "near"}]}},
        {"text": "far", "lang": "en", "coordinates": {"coordinates": [10.0, 40.8]}, "entities": {"hashtags": [{"text": "far"}]}},
        {"text": "nba", "lang": "es", "entities": {"hashtags": [{"text": "otro"}]}},
    ]
    (tmp_path / "in" / "m.json").write_text("\n".join(map(json.dumps, rows)))
    got = []
    stream = io.tagged_stream(spark, str(tmp_path / "in"), "nba", (-74.2, 40.5, -73.8, 41.0), ["en"])
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(r["tags"][0] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp"))
    assert sketches.watch(query.trigger(availableNow=True).start())
    assert sorted(got) == ["final", "nba", "near"]


def test_log_of_every_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    message = lambda *tags: json.dumps({"entities": {"hashtags": [{"text": t} for t in tags]}})
    (tmp_path / "in" / "m.json").write_text("\n".join([message("x", "y"), message("x"), message(), message("z")]))
    tags = sketches.reservoir_tags(io.tagged_stream(spark, str(tmp_path / "in")), each=True)
    writer = tags.writeStream.outputMode("update").foreachBatch(io.log_sink(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "cp"))
    assert sketches.watch(writer.trigger(availableNow=True).start())
    text = "".join(p.read_text() for p in sorted((tmp_path / "log").glob("*/part*")))
    head = "The number of tweets with tags from the beginning: "
    assert text == f"{head}1\nx : 1\ny : 1\n\n{head}2\nx : 2\ny : 1\n\n{head}3\nx : 2\ny : 1\nz : 1\n\n"


def messages(folder, records, files):
    """(id, tags) dealt over files, out of order."""
    folder.mkdir()
    for i in range(files):
        rows = [{"id": k, "lang": "en", "entities": {"hashtags": [{"text": t} for t in tags]}} for k, tags in records[i::files]]
        (folder / f"m{i}.json").write_text("\n".join(map(json.dumps, rows[::-1])))


def plain_reservoir(records, capacity=100, seed=1):
    """The rows after each record, one by one in the order of the ids."""
    import random
    from collections import Counter

    held, n, out = [], 0, []
    for _, tags in sorted(records):
        if tags:
            n += 1
            rng = random.Random(seed * 1_000_003 + n)
            if len(held) < capacity:
                held.append(tags)
            elif rng.random() < capacity / n:
                held[rng.randrange(capacity)] = tags
            counts = Counter(t for x in held for t in x)
            best = sorted(set(counts.values()), reverse=True)[:3]
            out += [(n, t, c) for t, c in counts.items() if c in best]
    return sorted(out)


@pytest.mark.parametrize("each", [False, True])
def test_top_tags_of_dealt_records(spark, tmp_path, monkeypatch, each):
    """Records of several files, in any order and sorted by several tasks, give the sample of a plain loop."""
    monkeypatch.setattr(sketches, "TO_SORT", 100)
    records = [(k, [f"t{k * k % 7}", f"t{k % 11}"][: k % 3]) for k in range(900)]
    messages(tmp_path / "in", records, 5)
    got = []
    sink = lambda df, batch: got.extend(map(tuple, df.collect()))
    feed = io.tagged_stream(spark, str(tmp_path / "in"), languages=["en"], order="id")
    assert sketches.watch(sketches.write_top_tags(feed, sink, str(tmp_path / "sample"), "id", each=each, trigger={"availableNow": True}, checkpointLocation=str(tmp_path / "cp")))
    every = plain_reservoir(records)
    assert sorted(got) == (every if each else [x for x in every if x[0] == 600])


@pytest.mark.parametrize("each", [False, True])
def test_top_tags_go_on_over_batches(spark, tmp_path, each):
    """A second run goes on from the sample of the first, also past a batch without tags; a batch run again gives the same rows."""
    records = [(k, [f"t{k * k % 7}"]) for k in range(400)]
    messages(tmp_path / "in", records[:250], 2)
    got = {}

    def run(fails=False):
        def sink(df, batch):
            got[batch] = sorted(map(tuple, df.collect()))
            if fails:
                raise RuntimeError("sink")

        feed = io.tagged_stream(spark, str(tmp_path / "in"), order="id")
        sketches.watch(sketches.write_top_tags(feed, sink, str(tmp_path / "sample"), "id", each=each, trigger={"availableNow": True}, checkpointLocation=str(tmp_path / "cp")))

    run()
    (tmp_path / "in" / "none.json").write_text(json.dumps({"id": 250}))
    run()
    messages(tmp_path / "more", records[250:], 1)
    (tmp_path / "more" / "m0.json").rename(tmp_path / "in" / "later.json")
    with pytest.raises(StreamingQueryException):
        run(fails=True)
    first = got[2]
    run()
    every = plain_reservoir(records)
    assert got[1] == [] and got[2] == first
    assert got[0] + got[2] == (every if each else [x for x in every if x[0] in (250, 400)])


def test_messages_are_written_by_many_tasks(spark, tmp_path):
    from siltstone.plans.catalogue import QUERIES, tag_stream

    spark.range(0, 3000, 1, 3).selectExpr("id AS event_id", "concat('t', id % 5) AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    with_parts = tag_stream(spark, str(tmp_path))
    assert spark.read.text(with_parts).select("value").count() == 3000
    assert spark.read.text(with_parts).selectExpr("input_file_name() AS f").distinct().count() > 1
    got = sorted(map(tuple, QUERIES["stream_top_tags"](spark, str(tmp_path)).collect()))
    assert got == [x for x in plain_reservoir([(k, [f"t{k % 5}"]) for k in range(3000)]) if x[0] == 3000]


def test_watch(spark, tmp_path):
    """A stream that runs on is stopped after the timeout; an error ends it quietly only if it is one to stop on."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n")

    def refuse(df, batch):
        raise RuntimeError("status 420")

    stream = spark.readStream.text(str(tmp_path / "in"))
    running = stream.writeStream.format("memory").queryName("watched").start()
    assert not sketches.watch(running, 2) and not running.isActive
    assert not sketches.watch(stream.writeStream.foreachBatch(refuse).start(), None, lambda e: "420" in e)
    with pytest.raises(StreamingQueryException):
        sketches.watch(stream.writeStream.foreachBatch(refuse).start())
    assert not sketches.watch(sketches.console(stream), 3)


def test_socket_stream(spark, tmp_path):
    import socket
    import threading

    server = socket.socket()
    server.bind(("127.0.0.1", 0))
    server.listen(2)

    def serve():
        for _ in range(2):
            try:
                c, _ = server.accept()
                c.sendall(b'{"city": "Graz"}\n{}\n')
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    got = []
    rows = sketches.parse_json(io.socket_lines(spark, "127.0.0.1", server.getsockname()[1]), "city")
    query = rows.writeStream.foreachBatch(lambda df, _: got.extend(r["key"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    sketches.watch(query, 6)
    server.close()
    assert sorted(got) == ["", "Graz"]


def test_window_estimates(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", f"c{s % 4}") for s in range(60)] + [("2024-01-01 01:00:00", "late")]
    df = spark.createDataFrame(rows, "t string, key string").selectExpr("cast(t AS timestamp) AS ts", "key")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = sketches.write_estimates(stream, lambda d, _: got.extend(d.collect()), trigger={"availableNow": True}, checkpointLocation=str(tmp_path / "cp"))
    query.awaitTermination()
    full = [r for r in got if r["start"].second in (0, 10, 20, 30) and r["start"].minute == 0 and r["start"].hour == 0]
    assert len(full) == 4 and {r["truth"] for r in full} == {4}
    assert all(abs(r["accuracy"] - (1 - abs(4 - r["estimate"]) / 4)) < 1e-9 for r in full)


def test_window_batches_run_once(spark, tmp_path):
    """What a batch hands on is read once, so its source and its state are too."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(key):
        seen.add(1)
        return key

    rows = [(f"2024-01-01 00:00:{s:02d}", f"c{s % 4}") for s in range(60)] + [("2024-01-01 01:00:00", "late")]
    df = spark.createDataFrame(rows, "t string, key string").selectExpr("cast(t AS timestamp) AS ts", "key")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).select("ts", told.asNondeterministic()("key").alias("key"))
    query = sketches.write_estimates(stream, lambda d, _: got.extend(d.collect()), trigger={"availableNow": True}, checkpointLocation=str(tmp_path / "cp"))
    sketches.watch(query)
    assert len(got) == 8 and seen.value == len(rows)
