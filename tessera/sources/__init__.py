"""Where documents, pages, chunks and graphs come from, and where they go."""
