"""marginalia: full-text search, retrieval and text-corpus analytics on PySpark.

Layout: ``functions`` (Column expressions), ``operators`` (DataFrame -> DataFrame),
``sources`` (readers, writers, snapshots), ``streaming`` (change feed), ``plans``
(the query catalogue with its SQL), ``llm`` (training-data operators; optional).
"""
