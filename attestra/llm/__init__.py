"""Training-data operators: extraction, cleaning, deduplication, packing and storage of text."""
