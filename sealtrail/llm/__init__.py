"""Operators for preparing training data: secrets, tokens, copies, licences, vectors, URLs, quality, packing, languages."""
