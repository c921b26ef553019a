"""Training-data operators: media, deduplication, quality, packing, tokenising, language models, chat and PII.

Nothing outside this subpackage imports it.
"""
