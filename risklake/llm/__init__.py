"""Training-data operators: de-duplication, filtering, scanning, scoring and mixing of text tables."""
