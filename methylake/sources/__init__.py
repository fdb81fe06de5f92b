"""methylake.sources."""
