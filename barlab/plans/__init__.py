"""barlab.plans."""
