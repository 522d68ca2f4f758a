"""Power spectra by grouped stages against numpy's transform."""
import numpy as np
from pyspark.sql import functions as F

from paytide.operators import evaluate as E

RNG = np.random.default_rng(3)


def test_lengths_even_uneven_and_prime_in_one_table(spark):
    lengths = {"square": 49, "even": 60, "prime": 307, "two": 2, "twice": 2 * 307}
    series = {name: RNG.normal(5, 2, n) for name, n in lengths.items()}
    rows = [(name, i, float(v)) for name, x in series.items() for i, v in enumerate(x)] + [(None, i, float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "name string, day int, v double").repartition(5)
    got = {}
    for r in E.power_spectrum(df, "v", "day", ("name",)).collect():
        got.setdefault(r["s"]["name"], {})[r["k"]] = r["p"]
    series[None] = np.array([float(i % 3) for i in range(12)])
    assert set(got) == set(series)
    for name, x in series.items():
        want = np.abs(np.fft.fft(x - x.mean())[1 : len(x) // 2 + 1]) ** 2
        assert sorted(got[name]) == list(range(1, len(want) + 1))
        assert np.allclose([got[name][k] for k in sorted(got[name])], want, atol=1e-8 * max(want.max(), 1))
    entropy = {r["name"]: r["SPECTRAL_ENTROPY"] for r in E.spectral_entropy(df, "v", "day", ("name",)).collect()}
    p = np.abs(np.fft.fft(series["prime"] - series["prime"].mean())[1:154]) ** 2
    assert abs(entropy["prime"] - -(p / p.sum() * np.log(p / p.sum() + 1e-12)).sum() / np.log(153)) < 1e-9


def test_constant_and_empty_series(spark):
    flat = spark.range(30).select(F.col("id").alias("day"), F.lit(4.0).alias("v"))
    assert [r["SPECTRAL_ENTROPY"] for r in E.spectral_entropy(flat, "v", "day").collect()] == [None]
    assert E.spectral_entropy(flat.limit(0), "v", "day").count() == 0


def test_twenty_thousand_days(spark):
    n = 20_011  # a prime
    days = spark.range(n).select(F.col("id").alias("day"), F.sin(F.col("id") * 0.7).alias("v"))
    x = np.sin(np.arange(n) * 0.7)
    p = np.abs(np.fft.fft(x - x.mean())[1 : n // 2 + 1]) ** 2
    got = E.spectral_entropy(days, "v", "day").first()["SPECTRAL_ENTROPY"]
    assert abs(got - -(p / p.sum() * np.log(p / p.sum() + 1e-12)).sum() / np.log(n // 2)) < 1e-6
