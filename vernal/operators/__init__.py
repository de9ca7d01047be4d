"""vernal.operators."""
