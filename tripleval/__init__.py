"""tripleval: reasoning-triplet preparation and text-model evaluation on Spark.

Every operator is a pure ``DataFrame -> DataFrame`` (or ``Column -> Column``)
transform.  Sub-packages:

* ``functions``  column expressions (whitespace strip, tokenisers, prompt
  templates, model-id rules)
* ``sources``    readers for the file formats and the test-table fixtures
* ``sinks``      JSONL / CSV / nested-JSON / Markdown writers
* ``operators``  splits, numbering, exploration, generation, metrics,
  comparison, run bookkeeping, training-data encoding, spectral statistics
* ``plans``      composite pipelines and the query registry
* ``streaming``  incremental run summary on Structured Streaming
"""

__version__ = "0.1.0"
