"""Spark-native commerce analytics: ingest, quality, dashboards, scoring, forecasts."""
