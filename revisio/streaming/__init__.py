"""Structured Streaming entry points for the row-local generators."""
from revisio.streaming.examples import stream_examples, stream_to_corpus  # noqa: F401
