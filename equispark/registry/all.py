"""Every registered query."""

from equispark.registry import derived, loading, logs, reports

QUERIES = {**loading.QUERIES, **derived.QUERIES, **reports.QUERIES, **logs.QUERIES}
