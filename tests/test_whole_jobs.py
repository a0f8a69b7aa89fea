"""Queries over fixtures that hold what an earlier cut left out."""

import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()


@pytest.fixture
def run(spark, tmp_path):
    """Writes the tables given by name as (rows, schema), then runs a query on them."""

    def go(query, **tables):
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return sorted(map(tuple, QUERIES[query](spark, str(tmp_path)).collect()), key=str)

    return go


def test_text_is_whole(run):
    documents = [("a", "ᎣᏏᏲ «Osiyo»…  café – it’s"), ("b", "(Ꭰ) [x], A-B? 》~"), ("c", None)], "doc_id string, text string"
    assert run("txt01_normalized", documents=documents) == [("a", "ꭳꮟᏺ osiyo café – it's".replace("Ᏺ", "ᏺ")), ("b", "ꭰ x ab 》~"), ("c", None)]
    assert run("txt03_cleaned", documents=documents) == [("a", "ꭳꮟᏺ «osiyo» café – it’s"), ("b", "ꭰ x a b ~"), ("c", None)]
    samples = [(str(k), t, None, None) for k, t in enumerate(["ᎣᏏᏲ", "Ꮏ! (ᎯᎠ)", "ꭰꮝꭹ", "ᎠᏍ x Ꮝ", None])], "sample_id string, syllabary_raw string, input_template string, gt_target string"
    assert run("txt05_phonetics", syllabary_samples=samples) == [("0", "ohsiyo"), ("1", "nha! (hi'a)"), ("2", "ahski"), ("3", "ahs X s"), ("4", None)]


def _lines(rows):
    """Lines of one recording from (seq, raw_text, speaker)."""
    return [(f"l{k:05}", "r", k, text, who) for k, text, who in rows], "line_id string, source_id string, seq long, raw_text string, speaker string"


def test_state_runs_over_whole_recordings(run):
    data = _lines([(k, "Ann: a b" if k == 3 else "a b", "A" if k < 1205 else "B") for k in (*range(3, 9), 199, 200, 499, 500, 1100, 1204, 1205, 2600)])
    keys = [r[2] for r in data[0]]
    upto, total = {}, 0
    for k in keys:
        total += 3 if k == 3 else 2
        upto[f"l{k:05}"] = total
    assert dict(run("jon15_running_prefix", codeswitched_lines=data)) == upto
    assert {r[1] for r in run("win06_speaker_carry", codeswitched_lines=data)} == {"Ann"}
    assert run("int07_speaker_turns", codeswitched_lines=data) == [("r", 1, "A", 3, 1204, 12), ("r", 2, "B", 1205, 2600, 2)]


def test_segments_run_over_whole_recordings(run, spark):
    events = spark.range(30).selectExpr("id as event_id", "'u' as user_id", "if(id % 15 < 13, 90d, 1d) as value", "cast(timestamp_seconds(id * 86400 * 4) as timestamp) as ts")
    assert run("str02_speech_segments", events=(events.collect(), events.schema)) == [("u", 0, 12), ("u", 15, 27)]


def test_segments_do_not_depend_on_blocks(spark):
    import random

    from utterframe.streaming.speech import advance, speech_segments, SpeechState

    rng = random.Random(4)
    data = [(s, t, rng.choice([0.0, 0.0, 9.0])) for s in "ab" for t in range(300)]
    df = spark.createDataFrame(data, "s string, t long, v double")
    for rule in ({"start_frames": 2, "stop_frames": 3, "least_frames": 2}, {"start_frames": 3, "stop_frames": 1, "least_frames": 4}):
        want = []
        for s in "ab":
            state = SpeechState()
            want += [(s, *x) for x in advance(state, [r[1:] for r in data if r[0] == s], 5.0, **rule)]
            if state.speaking and state.last - state.first + 1 >= rule["least_frames"]:
                want.append((s, state.first, state.last))
        for block in (1, 7, 1000):
            assert sorted(map(tuple, speech_segments(df, "s", "t", "v", 5.0, block=block, **rule).collect())) == sorted(want)


def _spoken(data, level, **rule):
    from utterframe.streaming.speech import advance, SpeechState

    by = {}
    for s, t, v in sorted(data, key=lambda r: (r[0], r[1], r[2] >= level)):
        by.setdefault(s, []).append((t, v))
    want = []
    for s, frames in by.items():
        state = SpeechState()
        want += [(s, *x) for x in advance(state, frames, level, **rule)]
        if state.speaking and state.last - state.first + 1 >= rule["least_frames"]:
            want.append((s, state.first, state.last))
    return sorted(want)


def test_segments_do_not_depend_on_batches(spark):
    import random

    from utterframe.streaming.speech import speech_segments

    rng, data = random.Random(5), []
    for s in range(24):
        share, n = rng.choice([0.05, 0.3, 0.5, 0.9, 0.0, 1.0]), rng.choice([1, 5, 40, 200])
        data += [(f"s{s}", rng.randrange(-40, 400), rng.choice([9.0, 5.0]) if rng.random() < share else rng.choice([0.0, float("nan")])) for _ in range(n)]
    df, name = spark.createDataFrame(data, "s string, t long, v double"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rule in ({"start_frames": 2, "stop_frames": 2, "least_frames": 1}, {"start_frames": 3, "stop_frames": 10, "least_frames": 5}, {"start_frames": 4, "stop_frames": 1, "least_frames": 30}, {"start_frames": 1, "stop_frames": 3, "least_frames": 2}):
        want = _spoken(data, 5.0, **rule)
        for block, rows in ((3, 1), (60, 7)):
            spark.conf.set(name, rows)
            try:
                assert sorted(map(tuple, speech_segments(df, "s", "t", "v", 5.0, block=block, **rule).collect())) == want
            finally:
                spark.conf.unset(name)


def test_segments_of_many_sparse_recordings(run, spark):
    """Recordings whose few frames lie far apart: a call of Python for each block of places takes too long."""
    import time

    rows = spark.range(12_000).selectExpr("id % 1000 as user_id", "id * 170 as event_id", "if(id div 1000 in (2, 3, 4, 9, 10), 90d, 1d) as value")
    data = rows.collect(), rows.schema
    began = time.time()
    got = run("str02_speech_segments", events=data)
    assert got == sorted(((str(u), (u + k * 1_000) * 170, (u + j * 1_000) * 170) for u in range(1_000) for k, j in ((2, 4), (9, 10))), key=str)
    assert time.time() - began < 15


def test_every_profile_has_a_column(run):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    chunks = [(f"c{k}", "s", k, 0.0, 1.0, p, at) for k, p in enumerate(["tune-a", "tune-a", None, "odd", "rare"])]
    tables = {"audio_chunks": (chunks, "chunk_id string, source_id string, chunk_index int, start_sec double, end_sec double, profile string, ingested_at timestamp"), "aligner_config": ([("tune-a",), ("scripture",)], "profile string")}
    assert run("snk11_wide_matrix", **tables) == [("s", 1, 0, 2, 2)]


def test_records_with_lost_words_take_part(run):
    texts = [("r1", "kanu tsalakiosiyo", "kanu"), ("r2", "osiyo", "osi yo"), ("r3", "kanu", "kanu")]
    data = [(k, "train", a, b, b, 0.0, 0.0, 0.0) for k, a, b in texts], "record_id string, split string, base_transliteration string, emitted_text string, reconciled_text string, raw_cer double, reconciled_cer double, delta_cer double"
    pairs = {(a, b): n for a, b, n, *_ in run("aln13_gram_alignment", enrichment_records=data)}
    assert pairs == {("kanu", "kanu"): 2, ("tsalakiosiyo", ""): 1, ("osiyo", "osiyo"): 1}
    assert {s for s, t, _ in run("em01_confusion_matrix", enrichment_records=data)} >= set("kanutslioy")


def test_all_symbols_can_be_decoded(run):
    frames = [("a", k, [9.0 if i == peak else 0.0 for i in range(64)]) for k, peak in enumerate([40, 0, 63])], "label string, vec_id long, embedding array<float>"
    assert [r[2] for r in run("aln20_beam_search", embeddings=frames) if r[1] == 1] == ["40 63"]
    (_, _, _, _, score), *_ = run("aln23_forced_alignment", embeddings=frames)
    assert score < -60


def test_no_item_is_out_of_reach(spark):
    from utterframe.operators.sets import balanced_subset

    rows = [(f"w{k:05}", f"l{k % 7}", ["a", "b", "c"]) for k in range(5100)] + [("x", "short", ["z"])]
    df = spark.createDataFrame(rows, "w string, l string, p array<string>")
    assert "x" in {r.w for r in balanced_subset(df, "w", "l", "p", 3).collect()}
