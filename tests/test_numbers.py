"""Floats as Python prints them (G9, A7): shortest digits that read back bit for bit."""

import math
import random
import struct

from pyspark.sql import functions as F

from pagelane.operators.render import json_number, number_text


def doubles():
    rng = random.Random(21)
    out = [0.0, -0.0, 1.0, -1.5, 0.1, 1e15, 1e16, 9999999999999998.0, 1e17, 123456789012345680.0, 1e22, 1e23, 1e-4, 9.999e-5, 1e-5, 5e-324, 2.2250738585072014e-308,
           1.7976931348623157e308, 2.675, 1234567.891, 0.30000000000000004, 2.0 ** -44, 2.0 ** 53 + 2, 4.35, 1e100, 12.5, math.pi, 100.0]
    out += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    out += [rng.uniform(-1e6, 1e6) for _ in range(1500)] + [round(rng.uniform(0, 1e5), 2) for _ in range(1500)]
    out += [rng.random() * 10.0 ** rng.randrange(-8, 20) for _ in range(1500)] + [5e-324 * rng.randrange(1, 2 ** 40) for _ in range(300)]
    return [x for x in out if math.isfinite(x)]


def test_numbers_read_back_bit_for_bit(spark):
    values = doubles()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", number_text(F.col("x")).alias("t")).collect()
    assert len(rows) == len(values)
    same = 0
    for r in rows:
        x = values[r.i]
        assert struct.pack("<d", float(r.t)) == struct.pack("<d", x), (x, r.t)
        same += r.t == repr(x)
    assert same >= 0.999 * len(values)  # powers of two may have another neighbour of as many digits


def test_numbers_without_a_value(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double").select(number_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == ["nan", "inf", "-inf", None]


def test_json_numbers(spark):
    import json
    values = doubles() + [float("nan"), float("inf")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", json_number(F.col("x")).alias("t")).collect()
    for r in rows:
        x = values[r.i]
        if not math.isfinite(x):
            assert r.t is None
            continue
        assert struct.pack("<d", json.loads(r.t)) == struct.pack("<d", x)
    forms = {1e16: "1e16", 1.5e-7: "1.5e-7", 1e-5: "0.00001", 9999999999999998.0: "9999999999999998.0", 1e22: "1e22", 3850.0: "3850.0", 2.675: "2.675"}
    got = {r.x: r.t for r in spark.createDataFrame([(x,) for x in forms], "x double").select("x", json_number(F.col("x")).alias("t")).collect()}
    assert got == forms
