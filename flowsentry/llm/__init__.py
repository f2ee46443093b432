"""Training-data pipeline operators (language model, dedup, tokenisers, ...)."""
