"""Feature detection, ranking and clustering as DataFrame operators."""
