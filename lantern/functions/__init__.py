"""Column functions: each takes and gives columns, and stays inside Spark's generated code."""

from lantern.operators.graph_build import base_name, category_from_image, role
from lantern.operators.logs import anomaly_score, extract_service, micros
from lantern.operators.metrics import metric_key
from lantern.operators.prom import health_status, matches
from lantern.operators.remediation import render, transition_reward
from lantern.operators.suggest import kind_class
from lantern.sources.readers import detect_source_format

__all__ = [
    "anomaly_score", "base_name", "category_from_image", "detect_source_format", "extract_service", "health_status", "kind_class", "matches", "metric_key", "micros", "render", "role", "transition_reward",
]
