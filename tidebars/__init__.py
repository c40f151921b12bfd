"""Daily-bar screening, scoring and backtesting as Spark DataFrame jobs."""
