"""Ordered operators: hand-worked vectors, skewed ties and partition invariance."""
import numpy as np
import pandas as pd

from statsmith.operators import ordered


def _vec(spark, vals):
    return spark.createDataFrame(pd.DataFrame({"i": range(len(vals)), "v": vals}), "i long, v double")


def test_linear_interpolation_vector(spark):
    df = _vec(spark, [None, 1.0, None, None, 4.0, None, None])
    for P in (1, 3, 5):
        got = ordered.interpolate_linear(df, "v", "i", num_partitions=P).orderBy("i").toPandas().v.tolist()
        assert np.isnan(got[0]) and got[1:] == [1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_ffill_bfill_vector(spark):
    df = _vec(spark, [None, 1.0, None, None, 4.0, None])
    ff = ordered.fill_forward(df, "v", "i", num_partitions=4).orderBy("i").toPandas().v.tolist()
    bf = ordered.fill_backward(df, "v", "i", num_partitions=4).orderBy("i").toPandas().v.tolist()
    assert np.isnan(ff[0]) and ff[1:] == [1.0, 1.0, 1.0, 4.0, 4.0]
    assert bf[:5] == [1.0, 1.0, 4.0, 4.0, 4.0] and np.isnan(bf[5])


def test_cubic_is_exact_on_cubic_data(spark):
    x = spark.range(0, 120).selectExpr(
        "id", "CASE WHEN id % 6 IN (2, 3) THEN NULL ELSE 0.25*id*id*id - id*id + 3.0 END AS v")
    got = ordered.interpolate_cubic(x, "v", "id", num_partitions=5).toPandas().sort_values("id")
    ids = got.id.to_numpy(float)
    mask = ids < 116
    assert np.allclose(got.v.to_numpy()[mask], (0.25 * ids ** 3 - ids ** 2 + 3.0)[mask], rtol=1e-12)


def test_fill_partition_invariance_with_groups(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"k": rng.integers(0, 1000000, n).astype(np.int64), "g": rng.choice(["a", "b", None], n),
                        "v": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n))})
    pdf = pdf.drop_duplicates("k")
    df = spark.createDataFrame(pdf, "k long, g string, v double")
    outs = [ordered.interpolate_linear(df, "v", "k", partition_by="g", num_partitions=P)
            .toPandas().sort_values("k").v.to_numpy() for P in (1, 7)]
    assert np.allclose(outs[0], outs[1], equal_nan=True)
    exp = pdf.sort_values("k").groupby("g", dropna=False)["v"].transform(lambda s: s.interpolate())
    assert np.allclose(outs[0], exp.to_numpy(), equal_nan=True)


def test_ranked_values_with_hot_value(spark):
    # one value holds a third of the rows
    n = 3000
    vals = [7.0] * (n // 3) + [float(i) for i in range(n - n // 3)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rv = ordered.ranked_values(df, "x", num_partitions=6).toPandas().sort_values("x")
    assert rv.cnt.sum() == n
    assert (rv.cum_before.to_numpy() == np.concatenate([[0], np.cumsum(rv.cnt.to_numpy())[:-1]])).all()
    assert rv.loc[rv.x == 7.0, "cnt"].item() == n // 3 + 1


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=501), "b": rng.integers(0, 5, 501).astype(float)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    q = {r["variable"]: r for r in ordered.quantiles(df, ["a", "b"], probs, num_partitions=4).collect()}
    for c in ("a", "b"):
        exp = pdf[c].quantile(probs).to_numpy()
        got = [q[c][f"q_{i}"] for i in range(len(probs))]
        assert np.allclose(got, exp, rtol=1e-12)


def test_bracket_quantiles_equal_full_path(spark):
    rng = np.random.default_rng(31)
    n = 20000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float),
                        "g": rng.choice(["x", "y"], n)})
    pdf.loc[: n // 3, "a"] = 1.25                        # a hot value: a third of the rows
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    fast = ordered.quantiles(df, ["a", "b"], probs, keys=["g"], method="bracket").toPandas().sort_values(["g", "variable"])
    full = ordered.quantiles(df, ["a", "b"], probs, keys=["g"], method="full").toPandas().sort_values(["g", "variable"])
    assert np.allclose(fast.filter(like="q_").to_numpy(), full.filter(like="q_").to_numpy(), rtol=0, atol=0)
    exp = pdf.groupby("g")["a"].quantile(probs).to_numpy()
    got = fast[fast.variable == "a"].filter(like="q_").to_numpy().ravel()
    assert np.allclose(got, exp, rtol=1e-12)


def test_three_quantile_methods_agree(spark):
    rng = np.random.default_rng(33)
    pdf = pd.DataFrame({"a": np.round(rng.normal(size=3000), 2), "g": rng.choice(["x", "y", "z"], 3000)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    res = [ordered.quantiles(df, ["a"], probs, keys=["g"], method=m).toPandas().sort_values("g")
           .filter(like="q_").to_numpy() for m in ("aggregate", "full", "bracket")]
    assert np.allclose(res[0], res[1], rtol=0, atol=1e-12) and np.allclose(res[1], res[2], rtol=0, atol=0)


def test_one_sided_lookups_and_null_key_bfill(spark):
    pdf = pd.DataFrame({"k": range(8), "g": ["a", None, "a", None, "a", None, "a", None],
                        "v": [None, 1.0, 2.0, None, None, 5.0, None, None]})
    df = spark.createDataFrame(pdf, "k long, g string, v double")
    nb = ordered.neighbours(df, "v", "k", sides=("prev",), num_partitions=3).orderBy("k").toPandas()
    # previous known row strictly before each row: none for rows 0 and 1
    assert nb["__sm_n1"].isna().all() and nb["__sm_p1"].notna().sum() == 6
    got = ordered.fill_backward(df, "v", "k", partition_by="g", num_partitions=3).orderBy("k").toPandas().v
    exp = pdf.groupby("g", dropna=False)["v"].transform(lambda s: s.bfill())
    assert np.allclose(got.to_numpy(float), exp.to_numpy(float), equal_nan=True)
