"""Training-data operators: filtering, deduplication, scoring, mixing, sharding and packing of documents."""
