"""Part of Feedlake."""
