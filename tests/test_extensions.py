import base64

import numpy as np
import pytest

from utterframe.functions.registry import add_noise, compose, measure, pcm_samples, register_functions, register_measure, resolve_vocabulary, tiling
from utterframe.session import broadcast_if_small, cut_lineage, small_enough, smallest_hashes


def test_measures():
    assert measure("plain", ["ab"], ["ab"])[0] == 0 and measure("related", ["ta"], ["da"])[0] == 0.3
    register_measure("length", lambda a, b: [abs(len(x) - len(y)) for x, y in zip(a, b)])
    assert measure("length", ["abc"], ["a"])[0] == 2
    with pytest.raises(KeyError):
        measure("none", [], [])


@pytest.mark.parametrize("colour", ["white", "pink"])
def test_noise_has_the_ratio_and_the_seed_decides(colour):
    x = np.sin(np.arange(800) / 7)
    y = add_noise(12.0, 3, colour)(x)
    assert abs(10 * np.log10(np.mean(x**2) / np.mean((y - x) ** 2)) - 12) < 1e-6
    assert np.array_equal(y, add_noise(12.0, 3, colour)(x)) and not np.array_equal(y, add_noise(12.0, 4, colour)(x))
    assert np.array_equal(compose(lambda v: v + 1, lambda v: v * 2)(np.ones(2)), [4, 4])


def test_payloads():
    floats = np.array([0.5, -1.0], "<f4")
    assert pcm_samples(base64.b64encode(floats.tobytes()).decode()).tolist() == [0.5, -1.0]
    ints = np.array([16384, -32768, 0], "<i2")
    assert pcm_samples(base64.b64encode(ints.tobytes()).decode()).tolist() == [0.5, -1.0, 0.0]


def test_vocabulary():
    assert resolve_vocabulary({"<pad>": 3, "|": 1, "a": 0}) == ({3: "<pad>", 1: "|", 0: "a"}, 3, 1)
    assert resolve_vocabulary({"a": 5}) == ({5: "a"}, 0, None) and resolve_vocabulary({"x": 2, " ": 4}, pad="x")[1:] == (2, 4)


def test_tiling():
    pieces = {"ab": ("X", 1.0), "a": ("A", 0.8), "b": ("B", 0.8), "c": ("C", 1.0)}
    assert tiling("abc", pieces) == ("XC", 2.0) and tiling("z", pieces) == ("z", 5.0) and tiling("", pieces) == ("", 0.0)


def test_sql_names(spark):
    register_functions(spark)
    assert spark.sql("select edit_cost('ta', 'da'), to_syllabary('tsalaki'), mora_tokens('gá'), edit_cost(null, 'a')").first()[:3] == (0.3, "ᏣᎳᎩ", "C 3_1")
    assert [tuple(r) for r in spark.sql("select op, ref, hyp from edit_ops('ab', 'b')").collect()] == [("delete", "a", ""), ("match", "b", "b")]
    assert [r[0] for r in spark.sql("select symbol from phoneme_spans('tsa')").collect()] == ["ts", "a"] and spark.sql("select * from edit_ops(null, 'b')").count() == 0


def test_session_helpers(spark):
    df = spark.range(10)
    assert small_enough(df, 10) and not small_enough(df, 9)
    assert cut_lineage(df).count() == 10 and broadcast_if_small(df, 3) is df


def test_hash_samples_do_not_depend_on_the_layout(spark):
    df = spark.range(5000)
    a = [r.id for r in smallest_hashes(df, 50, "id").collect()]
    assert len(set(a)) == 50 and a == [r.id for r in smallest_hashes(df.repartition(7), 50, "id").collect()]
    assert smallest_hashes(df.limit(30), 50, "id").count() == 30 and smallest_hashes(df.limit(0), 5, "id").count() == 0
