"""Training-data operators: quality, language, duplicates, mixing, token files and language-model scores."""
