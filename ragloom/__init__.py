"""ragloom: question-answer retrieval and answer evaluation as Spark jobs.

Layout
------
functions/   column expressions (vectors, text, prompts) - JVM side, no UDFs
operators/   DataFrame -> DataFrame operators (corpus, embed, topk, mmr,
             context, generate, judge, metrics, runs)
sources/     readers and writers (JSON, CSV, parquet) and the test-table mapping
plans/       end-to-end compositions (ingest, answer, evaluation run)
streaming/   Structured Streaming forms (question stream, document stream)
"""

__version__ = "0.1.0"
