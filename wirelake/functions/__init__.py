"""Part of the wirelake package."""
