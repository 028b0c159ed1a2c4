"""A documentation-corpus engine on Spark: tables of captured responses in, a versioned and searchable corpus out."""
