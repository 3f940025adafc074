"""Where memories come from and where they are kept."""
