"""Analytics on Spark: operators, sources, functions, plans and streams as plain functions."""
