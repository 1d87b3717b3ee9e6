"""A PySpark-native analytics engine for cohorts of spatial subject models."""
