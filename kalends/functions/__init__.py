"""Part of kalends."""
