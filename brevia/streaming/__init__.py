"""streaming of the compaction engine."""
