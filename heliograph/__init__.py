"""heliograph: a PySpark-native analytics engine for solar-plant telemetry."""
