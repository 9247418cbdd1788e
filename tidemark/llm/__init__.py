"""Training-data pipeline operators: token counts, PII, decontamination, dedup, quality, secrets, HTML, BPE."""
