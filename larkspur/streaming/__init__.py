"""Event-time operators for Structured Streaming (an extension; they run on batches as well)."""

from larkspur.streaming.windows import deduplicate, sessions, tumbling

__all__ = ["deduplicate", "sessions", "tumbling"]
