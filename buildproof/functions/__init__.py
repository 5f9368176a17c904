"""Part of the buildproof package."""
