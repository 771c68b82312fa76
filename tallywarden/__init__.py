"""Find unusual payment-like transactions with Spark DataFrames and streams."""
