"""Training-data pipeline operators (decontamination, PII, chat formatting,
near-dedup, quality, mixing, language ID, toxicity, WARC, line dedup).

Nothing else in the library imports this subpackage."""
