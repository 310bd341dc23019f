"""Operators for preparing training text: fingerprints, deduplication, chat formatting,
token counts, language ID, URL verdicts, packing and SentencePiece coding."""
