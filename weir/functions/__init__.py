"""Column helpers: durations, paths, labels, lookups in constant arrays."""

from .duration import parse_duration
from .expressions import exists_key, label_text, micros, num, path

__all__ = ["exists_key", "label_text", "micros", "num", "parse_duration", "path"]
