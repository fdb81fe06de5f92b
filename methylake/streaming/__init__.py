"""methylake.streaming."""
