"""Plans: end-to-end jobs (corpus ingest, search, generation tables) and the query registry."""
