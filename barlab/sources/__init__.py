"""barlab.sources."""
