"""methylake.functions."""
