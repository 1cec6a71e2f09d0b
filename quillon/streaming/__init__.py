"""Structured Streaming: append-only audit events, windows over them, a stateful limiter."""
