"""Moving frames put together of pieces against plain Python."""

from datetime import timedelta

import pytest

from recordvol.operators.frames import moving, size
from tests.test_averages import DAY

NAN = float("nan")


@pytest.mark.parametrize("before", [0, 1])
@pytest.mark.parametrize("bars", [3, 4, 10, 11, 25])
def test_moving_frames(spark, bars, before):
    values = [None, 1e15, 3.0, NAN, 2.0, None, None, None, None, None, *(float(i * 7 % 11) for i in range(40))]
    rows = spark.createDataFrame([("daily", "A", DAY + timedelta(i), v) for i, v in enumerate(values)], "timeframe string, ticker string, d date, x double")
    got = moving(rows, {how: (how, "x", bars) for how in ("sum", "max", "min")}, before, piece=4).withColumn("size", size(bars, before)).orderBy("d").collect()
    for i, r in enumerate(got):
        frame = values[max(0, i + 1 - before - bars) : i + 1 - before]
        own = [v for v in frame if v is not None]
        plain = [v for v in own if v == v]
        assert r["size"] == len(frame)
        if not own:
            assert (r["sum"], r["max"], r["min"]) == (None, None, None)
        else:
            # NaN is above all numbers; the frame after it, or after a large value, has the exact sum of its own values.
            assert str(r["max"]) == str(NAN if len(plain) < len(own) else max(own)) and str(r["min"]) == str(min(plain) if plain else NAN)
            assert str(r["sum"]) == str(NAN if len(plain) < len(own) else sum(own))
