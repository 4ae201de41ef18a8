"""Column expressions: JSON paths, transforms, typed normalisation, text keys, redaction."""
