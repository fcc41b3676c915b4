"""Operators for training-data pipelines: archives, licences, mixing, search, toxicity, language models, privacy, duplicates."""
