"""Training-data operators: quality rules, decontamination, WARC, similarity join, tokenising, chat, toxicity, dedup, sharding, HTML."""
