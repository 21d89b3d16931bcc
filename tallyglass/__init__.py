"""PySpark-native analytics over plans, outcomes and document text."""
