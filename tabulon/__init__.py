"""Table-in, table-out analytic operators for Spark DataFrames."""
