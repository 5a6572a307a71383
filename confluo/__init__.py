"""Spark-native record linkage, evidence fusion, data quality and catalog queries."""
