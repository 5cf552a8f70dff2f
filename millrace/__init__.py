"""A PySpark-native engine for stream analytics that feed an additive, time-partitioned cube."""
