"""DataFrame operators over ledgers, sequences and embeddings."""
