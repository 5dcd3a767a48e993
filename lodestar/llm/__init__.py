"""Training-data operators: search, packing, classification, dedup, extraction, mixing and archives."""
