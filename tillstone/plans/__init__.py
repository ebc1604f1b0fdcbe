"""Business queries, the star schema, the semantic layer and log analytics."""
