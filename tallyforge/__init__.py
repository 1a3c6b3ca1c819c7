"""Tallyforge: Spark-native auditing of experiment records."""
