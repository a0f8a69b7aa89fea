import numpy as np
import pytest

from utterframe.operators.signals import augmented, band_pass, denoise, quiet_parts, time_warp
from utterframe.sources.readers import read_arrays, read_chunks, read_matrix, read_revisions, read_transcript
from utterframe.sources.writers import write_matrix, write_vocabularies

RATE = 16_000
TIME = np.arange(RATE) / RATE


def tone(hertz):
    return np.sin(2 * np.pi * hertz * TIME)


def pitch(x):
    return np.abs(np.fft.rfft(x)).argmax() * RATE / len(x)


def test_a_warp_keeps_the_pitch():
    for rate in (0.8, 1.25):
        y = time_warp(tone(440), rate)
        assert len(y) == round(RATE / rate) and abs(pitch(y) - 440) < 5 and abs(np.std(y[2000:-2000]) - np.std(tone(440))) < 0.1
    assert np.array_equal(time_warp(tone(440), 1.0), tone(440)) and len(time_warp(np.zeros(0), 2.0)) == 0 and len(time_warp(np.ones(10), 2.0)) == 5
    with pytest.raises(ValueError):
        time_warp(tone(440), 0)


def test_a_band_pass_keeps_its_band():
    level = lambda hertz: np.std(band_pass(tone(hertz), RATE)[4000:]) / np.std(tone(hertz))
    assert level(1000) > 0.98 and abs(level(300) - 0.707) < 0.05 and abs(level(3400) - 0.707) < 0.05 and level(60) < 0.01 and level(7000) < 0.02
    assert len(band_pass(np.zeros(0), RATE)) == 0
    with pytest.raises(ValueError):
        band_pass(tone(9), RATE, 500, 300)


def test_noise_is_subtracted():
    rng = np.random.default_rng(1)
    noise = 0.3 * rng.standard_normal(RATE)
    clean = tone(440)
    y = denoise(clean + noise, 0.3 * rng.standard_normal(4000))
    assert np.std(y - clean) < 0.5 * np.std(noise)


def test_augmentation_repeats_itself():
    a, b = augmented(tone(440), 3, 1.0), augmented(tone(440), 3, 1.0)
    assert np.array_equal(a, b) and not np.array_equal(a, augmented(tone(440), 4, 1.0)) and np.array_equal(augmented(tone(440), 3, 0.0), tone(440))


def test_quiet_parts():
    level = np.full(100, -10.0)
    level[30:40], level[62:72] = -60.0, -60.0
    assert quiet_parts(level, 40, window=3, least=(10, 5)) == [(0, 30), (40, 62), (72, 100)]
    assert quiet_parts(level[:30], 40) == [(0, 30)] and quiet_parts(level[:0], 40) == []
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.uniform(-12, -8, int(rng.integers(1, 400)))
        parts = quiet_parts(x, 30, 3)
        assert max(b - a for a, b in parts) <= 30 and parts[0][0] == 0 and parts[-1][1] == len(x) and all(a2 <= b1 for (_, b1), (a2, _) in zip(parts, parts[1:]))
    with pytest.raises(ValueError):
        quiet_parts(level, 10, 2)


def test_transcripts_without_header(spark, tmp_path):
    def read(text):
        path = tmp_path / "t.txt"
        path.write_text(text, encoding="utf-8")
        return [tuple(r)[1:] for r in read_transcript(spark, str(path)).collect()]

    assert read("a text\n\nmore\n") == [("000001", None, None, None, "a text"), ("000003", None, None, None, "more")]
    assert read("v1\tᎠ\nv2\tᎡ\te\nv3\tᎢ\ti\tyes, it is\n") == [("v1", "Ꭰ", None, None, None), ("v2", "Ꭱ", "e", None, None), ("v3", "Ꭲ", "i", "yes, it is", None)]
    assert read('verse_id,phonetic,english\nv1,a,"b, c"\n') == [("v1", None, "a", "b, c", None)]


def test_artifacts(spark, tmp_path):
    cells = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25)], "s string, t string, v double")
    write_matrix(cells, str(tmp_path / "m"), "s", "t", "v")
    assert sorted(map(tuple, read_matrix(spark, str(tmp_path / "m")).collect())) == [("a", "b", 0.5), ("a", "c", 0.25)]
    (tmp_path / "flat.json").write_text('{"a|b": 0.5, "x|<del>": 1}')
    assert sorted(map(tuple, read_matrix(spark, str(tmp_path / "flat.json")).collect())) == [("a", "b", 0.5), ("x", "<del>", 1.0)]
    np.savez_compressed(tmp_path / "e.npz", lpz=np.arange(6.0).reshape(2, 3), tone=np.array([7, 8]), name=np.array("x"))
    got = read_arrays(spark, str(tmp_path / "e.npz")).collect()
    assert sorted((r.name, r.row, list(r["values"])) for r in got) == [("lpz", 0, [0.0, 1.0, 2.0]), ("lpz", 1, [3.0, 4.0, 5.0]), ("tone", 0, [7.0, 8.0])]
    (tmp_path / "c.json").write_text('{"entries": [{"id": "x", "text": "t"}, "bare"]}')
    assert [(r.chunk_id, r.text) for r in read_chunks(spark, str(tmp_path / "c.json")).collect()] == [("x", "t"), ("000002", "bare")]
    (tmp_path / "r.txt").write_text("# list\nmy model  abc12\n\nother f00\nalone\n")
    assert sorted(map(tuple, read_revisions(spark, str(tmp_path / "r.txt")).collect())) == [("my model", "abc12"), ("other", "f00")]
    write_vocabularies(spark, str(tmp_path / "v"), cv={"b": 1, "a": 0}, tone={"|": 0})
    assert [r[0] for r in spark.read.text(str(tmp_path / "v/cv")).collect()] == ['{"a": 0, "b": 1}']
