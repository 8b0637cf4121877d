"""Notice scanning on Spark."""
