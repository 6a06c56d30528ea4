"""DataFrame -> DataFrame operators: profiling, cleaning, ordered operators,
encoding, chart data, grouping, statistical tests and dimensionality
reduction.  Each module's docstring states how its work is distributed."""
