"""Tables in and out: Parquet and CSV, run log, model bundles."""
