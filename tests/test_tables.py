"""Relational operators, windows, sources, sinks and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from utterframe.functions import maths as M
from utterframe.operators import aggregates, filters, joins, ranking, sets, windows
from utterframe.sources import readers, writers
from utterframe.streaming.resume import append_missing, append_stream, session_stream
from utterframe.streaming.speech import SpeechState, advance, speech_segments, speech_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_checks():
    for bad in (0, 1, -1):
        with pytest.raises(ValueError):
            M.log_cost(None, bad)
    with pytest.raises(ValueError):
        aggregates.conditional_probabilities(None, "a", "b", "n", alpha=-1)


def test_maths(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7], 0.25)], "x array<double>, p double")
    r = df.select(M.argmax(F.col("x")), M.top_k(F.col("x"), 2), M.log_softmax(F.col("x")), M.log_cost(F.col("p"), 1e-4), M.padded(F.array(F.lit(1)), F.lit(3)), M.relative_improvement(F.lit(0.0), F.lit(1.0)), M.first_present(F.lit(""), F.lit(None).cast("string"), F.lit("z"))).first()
    assert r[0] == 1 and [(p.id, p.value) for p in r[1]] == [(1, 0.7), (2, 0.7)] and abs(sum(map(lambda v: 2.718281828459045**v, r[2])) - 1) < 1e-9
    assert 0 < r[3] < 1 and r[4] == [1, -100, -100] and r[5] == 0 and r[6] == "z"


def test_filters(spark):
    df = spark.createDataFrame([("a", 0.9), ("a", None), ("b", 0.9), ("b", 0.8), ("c", 0.5)], "k string, v double")
    assert rows(filters.accepted_groups(df, ["k"], F.col("v"), 0.5)) == [("b", 2)]
    out = filters.with_reject_reason(df, [("none", F.col("v").isNull()), ("low", F.col("v") < 0.6)])
    assert sorted(str(r.reject_reason) for r in out.collect()) == ["None", "None", "None", "low", "none"]
    assert df.where(filters.any_contains([F.col("k")], "A")).count() == 2
    assert df.select(filters.is_anomaly(F.col("v"), 0.6).alias("x")).where("x").count() == 2


def test_interval_join(spark):
    left = spark.createDataFrame([("s", i, i + 7) for i in range(0, 200, 5)], "k string, a long, b long")
    right = spark.createDataFrame([("s", 20, 90), ("s", 0, 3), ("t", 0, 300), ("s", 95, 180)], "k string, c long, d long")
    want = [("s", a, b, c, d) for _, a, b in left.collect() for k, c, d in right.collect() if k == "s" and (a >= c - 2 and b <= d + 2 or a < d and b > c)]
    for bucket in (10, 1000):
        got = joins.interval_join(left, right, ["k"], ("a", "b"), ("c", "d"), bucket, 2).select("k", "a", "b", "c", "d")
        assert rows(got) == sorted(want, key=str)


def test_interpolation(spark):
    p = spark.createDataFrame([("k", t) for t in (0, 5, 10, 15, 30)], "k string, t long")
    v = spark.createDataFrame([("k", 5, 1.0), ("k", 15, 3.0)], "k string, t long, v double")
    assert {r.t: r.v for r in joins.interpolated(p, v, ["k"], "t", "v").collect()} == {0: 0.0, 5: 1.0, 10: 2.0, 15: 3.0, 30: 0.0}


def test_lookups(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    assert rows(joins.lookup(df, t, ["k"], {"v": 0})) == sorted([("a", 1), ("b", 0), ("c", 0), (None, 0)], key=str)
    assert rows(joins.not_done(df, df.where("k = 'b' or k is null"), ["k"])) == [("a",), ("c",)]
    u = spark.createDataFrame([("a", 9), ("b", 8)], "k string, v int")
    assert rows(joins.first_hit(df, "k", [(t, "v"), (u, "v")], F.lit(7)).where("k is not null")) == [("a", 1), ("b", 8), ("c", 7)]


def test_windows(spark):
    df = spark.createDataFrame([(0, 10, "a"), (8, 12, "b"), (9, 11, "in"), (20, 30, "c")], "s long, e long, w string").withColumn("k", F.lit(1))
    tier = rows(windows.gap_filled(df, ["k"], "s", "e", "w", F.lit(40)))
    cells = sorted((r[1], r[2], r[3]) for r in tier)
    assert cells == [(0, 10, "a"), (10, 12, "b"), (12, 20, ""), (20, 30, "c"), (30, 40, "")]
    assert rows(windows.fused(df, ["k"], "s", "e", "w", 1).select("xmin", "xmax", "text")) == [(0, 13, "a b in"), (19, 31, "c")]
    m = rows(windows.midpoint_boundaries(df.where("w <> 'in'"), ["k"], "s", "e", ["s"]).select("w", "new_start", "new_end"))
    assert m == [("a", 0, 9), ("b", 9, 16), ("c", 16, 30)]
    pad = rows(windows.padded_intervals(df.where("w in ('b', 'c')"), ["k"], "s", "e", ["s"], 6, F.lit(5), F.lit(33)).select("w", "padded_start", "padded_end"))
    assert pad == [("b", 5, 16), ("c", 16, 33)]
    n = spark.range(70).withColumn("k", F.lit(1))
    w = windows.overlapping_windows(n, "id", 30, 1).groupBy("window_no").agg(F.count("*").alias("n"), F.min("offset").alias("a"), F.max("offset").alias("b"))
    assert rows(w) == [(0, 29, 0, 28), (1, 28, 1, 28), (2, 13, 1, 13)]


def test_sets(spark):
    s = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    n = {r.split: r["count"] for r in sets.hash_split(s, F.col("id"), "1").groupBy("split").count().collect()}
    assert 1500 < n["train"] < 1700 and sum(n.values()) == 2000
    a, b = s.limit(100), s.limit(7)
    mixed = sets.interleaved(a, b, "id").groupBy("domain").count().collect()
    assert {r.domain: r["count"] for r in mixed} == {0: 100, 1: 105}
    df = spark.createDataFrame([("x", 2, "q"), ("x", 1, "p"), ("y", 5, "r")], "k string, o int, v string")
    assert rows(sets.first_of(df, ["k"], ["o"])) == [("x", 1, "p"), ("y", 5, "r")]
    w = spark.createDataFrame([(f"w{i}", f"l{i % 10}", list(p)) for i, p in enumerate(["ab", "ab", "ab", "c", "d", "ce"] * 5)], "w string, l string, p array<string>")
    got = sets.balanced_subset(w, "w", "l", "p", 8, per_lemma=1).collect()
    assert len(got) == 8 and len({int(r.w[1:]) % 10 for r in got}) == 8


def test_probabilities(spark):
    c = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "b", 5)], "s string, t string, n long")
    p = aggregates.conditional_probabilities(c, "s", "t", "n", 1.0)
    got = {(r.s, r.t): round(r.p, 6) for r in p.collect()}
    assert got == {("a", "a"): 0.75, ("a", "b"): 0.25, ("b", "a"): round(1 / 7, 6), ("b", "b"): round(6 / 7, 6)}
    costs = {(r.s, r.t): r.cost for r in aggregates.log_costs(p, "s", "t", 1e-3, 6, 0.9).collect()}
    assert costs["a", "a"] == 0 and 0 < costs["a", "b"] < 1 and costs["b", "a"] == 0.9


def test_batches(spark):
    df = spark.createDataFrame([("k", i, 100 - i) for i in range(10)], "k string, id int, n int")
    got = ranking.length_batches(df, ["k"], "n", ["id"], 4).groupBy("batch_no").count()
    assert rows(got) == [(0, 4), (1, 4), (2, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Path;Sentence\nx.wav;hi\n")
    df = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert rows(df) == [("x.wav", "hi")] and readers.pick_column(df, ["text", "sentence"]) == "Sentence"
    with pytest.raises(ValueError):
        readers.pick_column(df, ["none"])
    (tmp_path / "b.json").write_text(json.dumps([{"id": "q", "phonetic": "", "text": "a"}, "bare"]))
    assert [(r.chunk_id, r.text) for r in readers.read_chunks(spark, str(tmp_path / "b.json")).orderBy("seq").collect()] == [("q", "a"), ("000002", "bare")]
    (tmp_path / "c.json").write_text(json.dumps({"k1": {"syllabary": "x", "raw_phonetic": "y"}, "k2": "z"}))
    assert [(r.chunk_id, r.text) for r in readers.read_chunks(spark, str(tmp_path / "c.json")).orderBy("seq").collect()] == [("k1", "y"), ("k2", "z")]
    (tmp_path / "d.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert rows(readers.read_records(spark, str(tmp_path / "d.jsonl"), "a int")) == [(1,), (2,)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.trans.txt").write_text("u-1 HELLO THERE\nu-2\n")
    (tmp_path / "s" / "1.wav").write_bytes(b"x")
    assert [(r.utt_id, r.text) for r in readers.read_utterances(spark, str(tmp_path / "s")).collect()] == [("u-1", "HELLO THERE")]
    assert readers.list_audio(spark, [str(tmp_path / "s")]).count() == 1 and readers.file_digests(spark, [str(tmp_path / "s")]).count() == 2
    (tmp_path / "e.tsv").write_text("t\t1,5\t2,0\t0,5\thello\nt\t1\t1\t0\tx\nt\t1\t2\t1\t \n")
    assert rows(readers.read_annotations(spark, str(tmp_path / "e.tsv"))) == [("t", 1.5, 2.0, 0.5, "hello")]
    (tmp_path / "f.txt").write_text("a\r\n\n b \n")
    assert [(r.line_id, r.text) for r in readers.read_lines(spark, str(tmp_path / "f.txt")).orderBy("seq").collect()] == [("line_000001", "a"), ("line_000003", "b")]


def test_textgrids(spark, tmp_path):
    cells = [("f", "one", 0.0, 1.5, 'say "x"'), ("f", "one", 1.5, 2.0, ""), ("f", "two", 0.0, 2.0, "y")]
    df = spark.createDataFrame(cells, "f string, t string, a double, b double, w string")
    text = writers.textgrid(df, "f", "t", "a", "b", "w").first().text
    (tmp_path / "x.TextGrid").write_text(text)
    short = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n2\n<exists>\n1\n"IntervalTier"\n"one"\n0\n2\n2\n0\n1.5\n"say ""x"""\n1.5\n2\n""\n'
    (tmp_path / "y.TextGrid").write_text(short)
    got = readers.read_textgrids(spark, str(tmp_path)).withColumn("n", F.regexp_extract("file", r"(.)\.TextGrid$", 1))
    assert rows(got.where("n = 'x'").select("tier", "idx", "xmin", "xmax", "text")) == [("one", 1, 0.0, 1.5, 'say "x"'), ("one", 2, 1.5, 2.0, ""), ("two", 1, 0.0, 2.0, "y")]
    assert rows(got.where("n = 'y'").select("tier", "idx", "xmin", "xmax", "text")) == [("one", 1, 0.0, 1.5, 'say "x"'), ("one", 2, 1.5, 2.0, "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c", 2, "b", None), ("c", 1, "a", "x")], "c string, o int, w string, e string")
    assert json.loads(writers.manifest(df, "c", ["o"], ["w", "e"]).first().json) == [{"w": "a", "e": "x"}, {"w": "b"}]
    writers.write_splits(df.withColumn("split", F.lit("train")).drop("c"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    writers.append_records(df, str(tmp_path / "r"))
    writers.append_records(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
    wide = writers.wide_matrix(spark.createDataFrame([("a", "b", 2)], "s string, t string, n long"), "s", "t", "n", ["a", "b"])
    assert rows(wide) == [("a", 0, 2)]


def test_speech_rule():
    s = SpeechState()
    quiet, loud = 0.0, 9.0
    frames = list(enumerate([loud, quiet, loud, loud, loud, loud, quiet, quiet, loud]))
    assert list(advance(s, frames, 5.0, start_frames=3, stop_frames=2, least_frames=2)) == [(0, 5)]
    assert s.active == 1 and not s.speaking and s.first == 8


def test_speech_batch_and_stream_agree(spark, tmp_path):
    import random

    rng = random.Random(1)
    data = [(f"s{k}", t, rng.choice([0.0, 9.0, 9.0])) for k in range(3) for t in range(400)]
    df = spark.createDataFrame(data, "s string, t long, v double")
    rule = {"start_frames": 2, "stop_frames": 2, "least_frames": 3}
    want = rows(speech_segments(df, "s", "t", "v", 5.0, **rule))
    for part in range(4):
        df.where(f"t >= {part * 100} and t < {part * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = speech_stream(stream, "s", "t", "v", 5.0, **rule)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")))
    open_ends = {w for w in want if w not in got}
    assert set(got) <= set(want) and len(open_ends) <= 3 and all(w[2] > 390 for w in open_ends)


def test_resume(spark, tmp_path):
    todo = spark.range(10).select("id")
    seen = []
    work = lambda x: (seen.append(x.count()), x.withColumn("y", F.col("id") * 2))[1]
    append_missing(todo.where("id < 4"), str(tmp_path / "r"), ["id"], work)
    out = append_missing(todo, str(tmp_path / "r"), ["id"], work)
    assert seen == [4, 6] and rows(out) == sorted([(i, 2 * i) for i in range(10)], key=str)


def test_streams_of_events(spark, tmp_path):
    df = spark.sql("select id % 2 as u, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(id * if(id < 6, 10, 60))) as ts from range(20)")
    df.unionAll(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = append_stream(s, str(tmp_path / "o"), str(tmp_path / "c"), ["u", "ts"], "ts", "1 hour").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 20
    q = session_stream(s, "u", "ts").writeStream.format("parquet").option("path", str(tmp_path / "o2")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o2"))
    assert got.where("n > 2").count() == 2 and got.count() >= 12
