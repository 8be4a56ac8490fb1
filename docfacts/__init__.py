"""Spark-first engine that turns benefit documents into analytics-ready tables."""
