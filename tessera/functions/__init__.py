"""Part of the catalogue engine."""
