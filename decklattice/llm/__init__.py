"""Training-data operators: URL filters, toxicity, quality, PII, decontamination,
token files, near-duplicates, mixing, line dedup and token counts.

Nothing outside this package imports it.
"""
