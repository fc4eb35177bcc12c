"""operators of the compaction engine."""
