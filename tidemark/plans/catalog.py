"""All registered queries: name -> (callable(spark, sf_dir), DuckDB text or None)."""

from tidemark.plans import evidence_queries, ingest_queries, lifecycle_queries, population_queries

QUERIES = {
    **ingest_queries.QUERIES,
    **lifecycle_queries.QUERIES,
    **population_queries.QUERIES,
    **evidence_queries.QUERIES,
}
