"""vernal.plans."""
