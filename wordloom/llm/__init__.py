"""Training-data operators: token counts, mixing, decontamination, deduplication, quality, language, licences, secrets.

Nothing outside this subpackage imports it.
"""
