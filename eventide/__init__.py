"""Event-cohort analytics on Spark."""
