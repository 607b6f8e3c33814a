"""Admission in rounds against the sequential model."""

import numpy as np
import pytest

from folioflow.operators import admission, budget

SCHEMA = "usage_date string, at long, reservation_id long, tokens long"


def model(rows, limit):
    used, out = {}, {}
    for day, at, i, tokens in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        fits = tokens is not None and used.get(day, 0) + tokens <= limit
        used[day] = used.get(day, 0) + (tokens if fits else 0)
        out[day, at, i] = (fits, used[day])
    return out


def check(spark, rows, limit, **options):
    found = admission.admit_in_rounds(spark.createDataFrame(rows, SCHEMA).repartition(3), limit, **options).collect()
    assert len(found) == len(rows)
    assert {(r["usage_date"], r["at"], r["reservation_id"]): (r["admitted"], r["used_after"]) for r in found} == model(rows, limit)


def test_one_hot_day(spark):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 500, 120_000)
    rows = [("d", int(i // 3), int(i), int(t)) for i, t in enumerate(tokens)] + [("e", 1, 1, 7), ("e", 2, 2, 10**9), (None, 1, 1, 9), (None, 1, 2, None)]
    check(spark, rows, 5_000_000, block_bits=8)


@pytest.mark.parametrize("most_rounds", [0, 2, 24])
def test_many_rounds(spark, most_rounds):
    rows = [("d", k, k, t) for k, t in enumerate(x for n in range(12) for x in (1, 40 - n))]  # each round ends at the next larger size
    rows += [("e", k, k, (k * 7) % 11) for k in range(60)] + [("neg", k, k, t) for k, t in enumerate([30, 20, -15, 10, 40, 5])] + [("none", 1, 1, None), ("big", 1, 1, 41), ("zero", 1, 1, 40), ("zero", 2, 2, 0), ("zero", 3, 3, 1), ("zero", 4, 4, 0)]
    check(spark, rows, 40, block_bits=2, most_rounds=most_rounds)


def test_random_days(spark):
    rng = np.random.default_rng(9)
    rows = [(f"d{rng.integers(6)}", int(rng.integers(50)), i, int(rng.integers(0, 60))) for i in range(900)]
    check(spark, rows, 300, block_bits=3)


def test_nothing(spark):
    assert admission.admit_in_rounds(spark.createDataFrame([], SCHEMA), 5).collect() == []


def test_same_columns_as_the_scan(spark):
    rows = spark.createDataFrame([("d", 1, 1, 3)], SCHEMA)
    assert sorted(admission.admit_in_rounds(rows, 5).dtypes) == sorted(budget.admit(rows, 5).dtypes)
