"""Sources and sinks: shared scratch space, snapshots, the commit log, Parquet tables."""
