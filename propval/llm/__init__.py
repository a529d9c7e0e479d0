"""Operators of a large-scale training-data pipeline (token counts, toxicity, exact top-k, secret scans,
embedding and SimHash near-duplicates, WARC, mixing, sharding, SentencePiece). Nothing else imports this package."""
