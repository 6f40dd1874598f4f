"""Training-data operators over transcripts: copies, mixing, quality, language, archives."""
