"""Running the detector on a stream: one full detection per micro-batch."""

from .micro_batch import detect_stream  # noqa: F401
