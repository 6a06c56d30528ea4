"""Write the physical plans of representative operators (sf0.1) to PLANS.md:
the operator tree plus each scan's ReadSchema / PushedFilters lines."""

from __future__ import annotations

import io
import os
import re
import sys
import tempfile
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from statsmith.operators import chartdata, clean, groups, ordered, tests_parametric  # noqa: E402
from statsmith.plans.fixtures import gappy, table  # noqa: E402
from statsmith.session import build_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    head = text.split("\n\n")[0]
    keep = [l for l in text.splitlines() if l.startswith(("ReadSchema", "PushedFilters"))]
    return head.strip() + "\n" + "\n".join(sorted(set(keep)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16,
                          extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="statsmith-plans-")})
    li = table(spark, sf, "lineitem")
    ev = table(spark, sf, "events")
    cases = [
        ("group statistics for two group variables: one GROUPING SETS aggregate, one scan",
         groups.group_stats(li, ["l_returnflag", "l_linestatus"], "l_quantity")),
        ("two-group filter pushed to the scan, partial aggregation before the shuffle",
         ev.where(F.col("event_type").isin("view", "purchase")).groupBy("event_type").agg(F.avg("value"))),
        ("outlier filter: literal bounds pushed to the parquet scan, two-column ReadSchema",
         clean.remove_outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                               "o_totalprice", "IQR")),
        ("histogram: bounded broadcast of <= 30 bin counts",
         chartdata.histogram(li, "l_extendedprice", 30)),
        ("linear interpolation: stored range-partitioned windows + one-row-per-partition carry frame",
         ordered.interpolate_linear(gappy(spark, sf), "v", "event_id")),
        ("chi-square detail: contingency cells from one aggregate",
         tests_parametric.chi_square_detail(li, "l_returnflag", "l_linestatus")),
    ]
    out = ["# Physical plans (sf0.1, local[8], AQE on)", "",
           "Generated by `python scripts/plans.py`. Scans show the pruned `ReadSchema` and any "
           "`PushedFilters`; `Exchange` nodes are the shuffles.", ""]
    for title, df in cases:
        out += [f"## {title}", "", "```", tree(df), "```", ""]
    text = "\n".join(out)
    text = re.sub(r"file:/[^\]]*?/(\w+)\.parquet", r"\1.parquet", text)
    text = re.sub(r"Scan ExistingRDD\[[^\]]*\]", "Scan ExistingRDD (stored checkpoint)", text)
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(text)
    spark.stop()


if __name__ == "__main__":
    main()
