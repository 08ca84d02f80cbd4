"""Part of kelpline."""
