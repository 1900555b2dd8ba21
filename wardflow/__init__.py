"""District-plan analytics on Spark."""
