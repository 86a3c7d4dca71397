from engram.plans import further, language, lifecycle, lookups, parsing, queries, records, scopes, upkeep  # noqa: F401  each registers its queries
