"""Spark-native ingestion of dumps, delimited text and spreadsheets into well-defined DataFrames."""
