"""Incremental (Structured Streaming) forms of the append sinks (S9) and of scoring."""
