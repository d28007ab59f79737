"""Training-data operators: text, page, vector and conversation tables to clean, counted, packed and scored corpora."""
