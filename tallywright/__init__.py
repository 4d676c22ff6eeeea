"""tallywright: a PySpark-native analytics engine for operational gap findings."""
