"""Named relational plans: Spark SQL over DataFrames, and the same relation as one DuckDB statement for checks."""
