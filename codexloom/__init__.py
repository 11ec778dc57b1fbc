"""codexloom: a PySpark-native engine for versioned, cross-referenced documents.

``sources``    readers and writers (tables, HTML filings, graph interchange)
``functions``  column expressions that stay inside the JVM
``operators``  graph, temporal, text, vector, retrieval, packing and metric operators
``plans``      the query catalogue with its DuckDB counterparts
``streaming``  Structured Streaming forms of the incremental operators
``llm``        training-data operators; optional, nothing else imports it
"""

__version__ = "0.1.0"
