"""sources of the compaction engine."""
