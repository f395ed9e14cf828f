"""Reports written from a profile."""
