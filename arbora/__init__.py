"""An analytics engine that is Spark: DataFrame, SQL and Column building blocks with group tables and lenient functions."""
