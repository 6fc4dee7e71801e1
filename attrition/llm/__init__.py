"""Training-data operators: quality rules, sharding, token counts, similarity join, packing, secrets, WARC, search, mixing."""
