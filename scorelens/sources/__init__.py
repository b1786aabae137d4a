from scorelens.sources.tables import load_table, sample_view, SAMPLE_SQL  # noqa: F401
