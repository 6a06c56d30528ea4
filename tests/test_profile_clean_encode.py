"""Sources, profiling, cleaning, encoding and chart data."""
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statsmith.operators import chartdata, clean, encode, groups, profile
from statsmith.sources import read_table, write_csv


def test_read_table_csv_types_and_tokens(spark):
    d = tempfile.mkdtemp(prefix="statsmith-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d,e,f\n1,1.5,True,2020-01-01,x,NA\n2,,False,2020-01-02,NA,\n,2.5,true,2020-01-03,y,null\n")
    df = read_table(spark, p)
    types = dict(df.dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "double"}
    rows = df.orderBy(F.col("a").asc_nulls_last()).collect()
    assert rows[0]["a"] == 1 and rows[1]["b"] is None and rows[1]["e"] is None and rows[2]["c"] is True
    out = os.path.join(d, "out")
    write_csv(df, out)
    back = read_table(spark, out)
    assert back.count() == 3 and dict(back.dtypes)["a"] == "bigint"


def test_read_table_rejects_case_duplicates(spark):
    d = tempfile.mkdtemp(prefix="statsmith-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("p,P\n1,2\n")
    with pytest.raises(ValueError):
        read_table(spark, p)


def test_describe_and_missing(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, None, 4.0, 10.0], "s": ["a", "b", "b", None, "c"]})
    df = spark.createDataFrame(pdf, "x double, s string")
    t = profile.describe_transposed(df).first()
    exp = pdf.x.describe()
    assert t["count"] == 4 and t["mean"] == pytest.approx(exp["mean"]) and t["std"] == pytest.approx(exp["std"])
    assert [t["q25"], t["q50"], t["q75"]] == pytest.approx([exp["25%"], exp["50%"], exp["75%"]])
    ms = {r["column"]: (r["missing_count"], r["percentage"]) for r in profile.missing_summary(df).collect()}
    assert ms == {"x": (1, 20.0), "s": (1, 20.0)}
    info = profile.info(df).collect()
    assert [(r["column"], r["non_null"], r["n_rows"]) for r in info] == [("x", 4, 5), ("s", 4, 5)]
    obj = {r["variable"]: r for r in profile.describe(df.select("s")).collect()}
    assert obj["s"]["unique"] == 3 and obj["s"]["top"] == "b" and obj["s"]["freq"] == 2


def test_fill_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "s string")
    got = sorted(r[0] for r in clean.fill_missing(df, "s", "mode").collect())
    assert got == ["a", "a", "a", "b", "b"]
    nul = spark.createDataFrame([(None,), (None,)], "s string")
    assert clean.fill_missing(nul, "s", "mode").where(F.col("s").isNotNull()).count() == 0


def test_outliers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert sorted(r[0] for r in clean.remove_outliers(df, "x", "IQR").collect()) == [1.0, 2.0, 3.0, 4.0]
    rep = clean.outlier_report(df, "x", "IQR").first()
    assert (rep["n_before"], rep["n_after"], rep["removed"]) == (6, 4, 2)
    const = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert clean.remove_outliers(const, "x", "zscore").count() == 0
    with pytest.raises(ValueError):
        clean.remove_outliers(spark.createDataFrame([("a",)], "s string"), "s", "IQR")


def test_label_encode_text_rules(spark):
    df = spark.createDataFrame([(10000000.0, True, "b"), (0.0001, False, None), (2.5, True, "a")],
                               "d double, t boolean, s string")
    _, m = encode.label_encode(df, "d")
    assert sorted(r["class"] for r in m.collect()) == ["0.0001", "10000000.0", "2.5"]
    enc, m = encode.label_encode(df, "s")
    assert {r["class"]: r["code"] for r in m.collect()} == {"a": 0, "b": 1, "nan": 2}
    _, m = encode.label_encode(df, "t")
    assert {r["class"]: r["code"] for r in m.collect()} == {"False": 0, "True": 1}


def test_scalers_follow_library_conventions(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 6.0], "c": [5.0] * 4, "y": [0.0, 1.0, 0.0, 1.0]})
    df = spark.createDataFrame(pdf)
    st = encode.scale(df, "standard", target="y").toPandas()
    assert np.allclose(st.x, (pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0)) and (st.c == 0).all()
    assert (st.y == pdf.y).all()
    mm = encode.scale(df, "minmax", target="y").toPandas()
    assert np.allclose(mm.x, [0, 0.2, 0.4, 1.0]) and (mm.c == 0).all()
    rb = encode.scale(df, "robust", target="y").toPandas()
    q1, q2, q3 = pdf.x.quantile([0.25, 0.5, 0.75])
    assert np.allclose(rb.x, (pdf.x - q2) / (q3 - q1)) and (rb.c == 0).all()


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.gamma(2.0, 3.0, 2000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = chartdata.histogram(df, "x", 30).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=30)
    assert h["count"].tolist() == counts.tolist()
    assert np.allclose(h.lower, edges[:-1]) and np.allclose(h.upper, edges[1:])
    const = spark.createDataFrame([(3.0,)] * 5, "x double")
    hc = chartdata.histogram(const, "x", 30).toPandas()
    assert hc["count"].sum() == 5 and hc.lower.min() == pytest.approx(2.5)


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.1, 3.0), (3.0, 5.9, 3.0), (None, 1.0, 3.0)],
                               "a double, b double, c double")
    m = {(r["var1"], r["var2"]): r["corr"] for r in chartdata.correlation_matrix(df).collect()}
    assert m[("a", "c")] is None and m[("a", "a")] == pytest.approx(1.0)
    assert m[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_group_stats_multiple_variables_one_pass(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0), (None, "y", 5.0)],
                               "g string, h string, v double")
    r = {(x["group_variable"], x["level"]): x for x in groups.group_stats(df, ["g", "h"], "v").collect()}
    assert set(r) == {("g", "a"), ("g", "b"), ("h", "x"), ("h", "y")}
    assert r[("h", "y")]["count"] == 2 and r[("h", "y")]["mean"] == pytest.approx(3.5)
    ct = {(x["g"], x["h"]): x["count"] for x in groups.crosstab(df, "g", "h").collect()}
    assert ct == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("b", "y"): 0}


def test_wide_correlation_matches_pandas_pairwise(spark):
    from statsmith.operators.gram import WIDE
    rng = np.random.default_rng(17)
    p = WIDE + 3
    X = rng.normal(size=(300, p)) @ rng.normal(size=(p, p)) + 100
    X[rng.random(X.shape) < 0.1] = np.nan
    X[:, 5] = 7.0                                   # constant column
    pdf = pd.DataFrame(X, columns=[f"c{i}" for i in range(p)])
    df = spark.createDataFrame(pdf).repartition(4)
    got = {(r["var1"], r["var2"]): r["corr"] for r in chartdata.correlation_matrix(df).collect()}
    exp = pdf.corr()
    for a in ("c0", "c5", "c17"):
        for b in ("c1", "c5", "c30", "c0"):
            e = exp.loc[a, b]
            g = got[(a, b)]
            if np.isnan(e):
                assert g is None
            else:
                assert g == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_float_text_matches_python_str(spark):
    vals = [10000000.0, 0.0001, 1e16, 1.5e-05, 123.25, -2.5, 0.1, 1e-300, -1e22, 3.0, 0.0, -0.0,
            float("inf"), 1234567890123.5, 2.5e-4]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(encode.as_text(df, "d")).collect()]
    assert got == [str(v) for v in vals]


def test_label_mapping_large_class_set_uses_distributed_path(spark, monkeypatch):
    monkeypatch.setattr(encode, "SMALL_CLASS_SET", 3)
    df = spark.createDataFrame([(s,) for s in ["b", "a", "é", "Z", "a", "10", "9"]], "s string")
    enc, m = encode.label_encode(df, "s")
    got = {r["class"]: r["code"] for r in m.collect()}
    assert got == {c: i for i, c in enumerate(sorted(["b", "a", "é", "Z", "10", "9"]))}
    assert sorted(r[0] for r in enc.collect()) == sorted(got[c] for c in ["b", "a", "é", "Z", "a", "10", "9"])


def test_describe_matches_pandas_layout(spark):
    rng = np.random.default_rng(19)
    pdf = pd.DataFrame({"a": rng.normal(size=97), "b": rng.integers(0, 9, 97).astype(np.int64),
                        "s": rng.choice(["u", "v"], 97)})
    pdf.loc[::7, "a"] = np.nan
    got = profile.describe(spark.createDataFrame(pdf)).toPandas().set_index("stat")
    exp = pdf.describe()
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%",
             "q75": "75%", "max": "max"}
    for ours, theirs in names.items():
        for c in ("a", "b"):
            assert got.loc[ours, c] == pytest.approx(exp.loc[theirs, c], rel=1e-12)


def test_read_table_quoted_fields(spark):
    d = tempfile.mkdtemp(prefix="statsmith-csv-")
    p = os.path.join(d, "q.csv")
    with open(p, "w") as f:
        f.write('name,note,n\n"Smith, J","said ""hi""",3\n"Lee",,4\n')
    rows = read_table(spark, p).orderBy("n").collect()
    assert rows[0]["name"] == "Smith, J" and rows[0]["note"] == 'said "hi"' and rows[0]["n"] == 3
    assert rows[1]["note"] is None


def test_write_csv_uses_pandas_text_forms(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="statsmith-csv-")
    df = spark.createDataFrame([(1e7, True, dt.datetime(2020, 1, 2, 3, 4, 5), "x"),
                                (float("nan"), False, None, None)],
                               "d double, b boolean, t timestamp, s string")
    out = os.path.join(d, "o")
    write_csv(df.coalesce(1), out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert text.splitlines() == ["d,b,t,s", "10000000.0,True,2020-01-02 03:04:05,x", ",False,,"]
