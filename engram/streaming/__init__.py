"""Index upkeep and read counters over streams."""
