"""vernal.streaming."""
