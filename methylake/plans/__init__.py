"""methylake.plans."""
