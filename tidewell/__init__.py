"""tidewell: key-value analytics, log search and corpus preparation on PySpark DataFrames."""
