"""methylake.operators."""
