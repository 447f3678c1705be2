"""Query catalogue: ``queries()`` and ``oracle_sql()`` of the general engine."""
