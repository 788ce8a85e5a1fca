"""Calendar, contact and CSV output."""
