"""ML preparation, model registry, metrics and clustering."""
