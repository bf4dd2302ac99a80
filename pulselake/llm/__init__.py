"""Training-data operators: deduplication, scoring, scanning, packing and tokenising of document tables."""
