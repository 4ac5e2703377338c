"""Text columns, folds and the tracker against plain Python."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from headway.functions import words as W
from headway.operators import folds
from headway.streaming import fixes as streamed


def official(text):
    out, low = "", text.lower()
    for i, c in enumerate(low):
        start = i == 0 or not low[i - 1].isalpha()
        if c == "г" and i and low[i - 1] == "з":
            out += "gh"
        elif c in W.STARTS:
            out += W.STARTS[c][0 if start else 1]
        else:
            out += W.LETTERS.get(c, c)
    return out


NAMES = ["Згурський", "Їжакевича", "п’ять кутів", "Юр'ївська єЄ", "Щирецька", "Ґалицька", "Złota", "йойк Якця-Яма", "Ёлка", "12 Ї", "", None]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "s string")
    s = F.col("s")
    rows = df.select("s", W.folded(s).alias("f"), W.romanised(s).alias("o"), W.typed(s).alias("t"), W.romanisations(s).alias("r")).collect()
    for r in rows:
        if r.s is None:
            assert r.f is None and r.o is None
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", r.s.casefold()) if not unicodedata.combining(c)).replace("ł", "l")
        letters = W.LETTERS | W.TYPED
        assert r.f == bare
        assert r.o == official(r.s)
        assert r.t == "".join(letters.get(c, c) for c in r.s.lower())
        assert all(x and x != r.s.lower() for x in r.r)


@pytest.mark.parametrize("text, street, number", [
    ("стрийська 15", "стрииська", "15"), ("Зелена 15/2", "зелена", "152"), ("Зелена 1-А", "зелена", "1a"), ("15", "15", ""),
    ("154 км", "154 км", ""), ("1 а", "1 а", ""), ("Зелена", "зелена", ""), ("", "", ""), ("15 вулиця 3", "15 вулиця", "3"),
])
def test_house_numbers(spark, text, street, number):
    a, b = W.street_and_number(F.col("f"))
    row = spark.createDataFrame([(text,)], "s string").withColumn("f", W.folded(F.col("s"))).select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b) == (street, number)


def test_tracked(spark):
    """A vehicle that pauses, one of a single fix, two fixes at one time."""
    data = [(i, 1, 100 + 10 * i + (400 if i > 5 else 0), 50.0 * i, 5.0 + i % 3) for i in range(12)] + [(20, 2, 7, 3.0, 1.0), (21, 3, 5, 1.0, 2.0), (22, 3, 5, 9.0, 0.0), (23, 3, 6, 2.0, 8.0)]
    got = {r.fix: (r.s, r.v) for r in streamed.tracked(spark.createDataFrame(data, "fix long, veh long, veh_ts long, dist double, speed double")).collect()}
    want, last = {}, None
    snap, fast, acc = streamed.SNAP, streamed.SPEED, streamed.ACCEL
    for fix, veh, t, d, u in data:
        if last is None or last[0] != veh or t - last[1] > streamed.STALE:
            s, v, a, b, c = d, u, snap, 0.0, fast
        else:
            g = t - last[1]
            s, a, b, c = s + v * g, a + 2 * g * b + g * g * c + (0.5 * acc * g * g) ** 2, b + g * c, c + (acc * g) ** 2
            x, z = a + snap, c + fast
            det = x * z - b * b
            k, l, m, n = (a * z - b * b) / det, (b * x - a * b) / det, (b * z - c * b) / det, (c * x - b * b) / det
            e, f = d - s, u - v
            s, v, a, b, c = s + k * e + l * f, max(0.0, v + m * e + n * f), (1 - k) * a - l * b, (1 - k) * b - l * c, -m * b + (1 - n) * c
        last, want[fix] = (veh, t), (s, v)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_deadband(spark):
    data = [(1, i, k, v) for i, (k, v) in enumerate([("a", 0), ("a", 4), ("a", 6), ("b", 6), ("b", 1), ("b", 0), ("a", 0), ("a", 5)])] + [(2, 0, "a", 9)]
    rows = folds.deadband(spark.createDataFrame(data, "key long, t long, kind string, v long"), ["key"], ["t"], "kind", "v", 5).collect()
    assert sorted((r.key, r.t) for r in rows) == [(1, 0), (1, 2), (1, 3), (1, 5), (1, 6), (2, 0)]
