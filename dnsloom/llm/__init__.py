"""Training-data operators: search, classification, de-duplication, scans, mixing and output."""
