"""Published golden values of the integer voice-activity functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import voice


@pytest.mark.parametrize("x,mean,std,prob,delta", [(0, 0, 128, 1048576, 0), (16, 128, 128, 1048576, 0), (-16, -128, 128, 1048576, 0), (59, 0, 128, 1024, 7552), (75, 128, 128, 1024, 7552), (-75, -128, 128, 1024, -7552), (105, 0, 128, 0, 13440)])
def test_likelihood(spark, x, mean, std, prob, delta):
    df = spark.createDataFrame([(x, mean, std)], "x int, m int, s int")
    assert tuple(df.select(voice.gaussian_likelihood(F.col("x"), F.col("m"), F.col("s"))).first()[0]) == (prob, delta)


def test_halving():
    out, state = voice.halve_rate(np.zeros(960, np.int64))
    assert not out.any() and state == (0, 0)
    x = (np.arange(960) ** 2).astype(np.int16).astype(np.int64)
    assert voice.halve_rate(x)[1] == (207, 2270)


def test_minimum():
    want = [1600, 720, 509, 512, 532, 552, 570, 588, 606, 624, 642, 659, 675, 691, 707, 723, 1600, 544, 502, 522, 542, 561, 579, 597, 615, 633, 651, 667, 683, 699, 715, 731]
    m = voice.TrackedMinimum()
    for i in range(16):
        assert m.update(500 * (i + 1), i) == want[i]
        assert m.update(12_000, i) == want[i + 16]
