"""plans of the compaction engine."""
