"""Table-level operators for keeping and querying large registries on Spark."""
