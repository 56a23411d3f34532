"""Operations of a training-data pipeline; their queries are in ``rowloom.llm.catalog``."""
