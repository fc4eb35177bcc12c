"""functions of the compaction engine."""
