"""The same operators over streams of events."""

from .events import stream_ramps, stream_readings, stream_thinned

__all__ = ["stream_ramps", "stream_readings", "stream_thinned"]
