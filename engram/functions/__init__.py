"""Text, extraction and rendering as Column functions."""
