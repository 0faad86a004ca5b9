"""Training-data operators: near-duplicate search, filtering, recognition, mixing and id output."""
