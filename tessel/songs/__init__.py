"""Songs as nested rows: schemas, lead sheets, prompts, checks, repairs and event tables."""
