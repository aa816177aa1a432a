"""risklake: portfolio-risk and device-telemetry analytics on Spark DataFrames."""
