"""Queries of the training-data operators, with the SQL that gives the same rows."""

from folium.llm import decontamination, embeddings, language_id, licenses, minhash, packing, sharding, suffixes, token_counts, warc

MODULES = (licenses, token_counts, embeddings, suffixes, sharding, language_id, packing, warc, decontamination, minhash)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
