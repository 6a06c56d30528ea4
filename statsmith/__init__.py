"""statsmith: a PySpark-native statistics and modelling workbench.

Every operator takes a Spark ``DataFrame`` and returns ``DataFrame`` results.
Heavy passes (scans, group-bys, range-partitioned prefix sums, Gram sums) run
on the executors; only summaries whose size is bounded by the number of
columns, groups or partitions ever reach the driver.
"""

from statsmith.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
