"""vernal.functions."""
