"""Reports of findings."""
