"""Training-data operators: dedup, fingerprints, tokens, quality, PII, packing, language.

Nothing else in the library imports this subpackage; ``scorelens.llm.queries``
holds its registered queries and oracle SQL.
"""
