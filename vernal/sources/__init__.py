"""vernal.sources."""
