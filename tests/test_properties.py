"""Property tests: ordered operators agree with pandas on random vectors
(gaps, ties, any partition count)."""
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from statsmith.operators import ordered

vectors = st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40)
parts = st.integers(1, 9)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=vectors, P=parts)
def test_linear_interpolation_property(spark, vals, P):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(vals)), "v": vals}), "i long, v double")
    got = ordered.interpolate_linear(df, "v", "i", num_partitions=P).orderBy("i").toPandas().v.to_numpy(float)
    exp = pd.Series(vals, dtype=float).interpolate(method="linear").to_numpy()
    assert np.allclose(got, exp, equal_nan=True)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.integers(-3, 3).map(float), min_size=1, max_size=60), P=parts,
       probs=st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_quantiles_property(spark, vals, P, probs):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    row = ordered.quantiles(df, ["x"], probs, num_partitions=P, method="full").first()
    exp = np.quantile(np.array(vals), probs)       # linear interpolation
    assert np.allclose([row[f"q_{i}"] for i in range(len(probs))], exp, rtol=1e-12, atol=1e-12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.integers(0, 6), min_size=1, max_size=60), P=parts)
def test_average_ranks_property(spark, vals, P):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    rv = ordered.average_ranks(df, "x", num_partitions=P).toPandas().set_index("x")
    exp = pd.Series(vals, dtype=float).rank(method="average")
    for v, r in zip(vals, exp):
        assert rv.loc[float(v), "avg_rank"] == r
