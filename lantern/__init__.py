"""Service-observability analytics as DataFrame operators on Spark."""
