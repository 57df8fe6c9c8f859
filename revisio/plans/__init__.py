"""Composite jobs: corpus recipes (build), training preparation, scoring."""
