"""A PySpark-native analytics engine for screening registers of public works."""
