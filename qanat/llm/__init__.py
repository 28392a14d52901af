"""Training-data operators (token counts, PII, language ID, ...). Nothing outside this subpackage imports it."""
