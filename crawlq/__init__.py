"""crawlq: crawl-frontier and profile analytics as Spark DataFrame operators.

Modules:

* ``operators.queue_reads``: prioritised / paged queue reads (top-k).
* ``operators.joins``: completed-profile and seed-lineage joins, semi/anti joins.
* ``operators.stats``: status roll-ups.
* ``operators.merge``: upsert, insert-if-absent, status patches, claims, cursor.
* ``operators.ingest``: keyword / seed / URL / profile ingest with per-request rules.
* ``operators.frontier``: friend edges and depth-limited frontier expansion.
* ``functions.columns`` / ``functions.reports``: column expressions.
* ``plans.normalize``: per-table normalisers; ``plans.registry``: registered queries.
* ``sources``: declared schemas, parquet tables, test-table adapters.
* ``streaming.stream``: checkpointed landing of streams, then merges.

Every operator takes and returns DataFrames and builds on Spark's own
expressions; nothing is collected to the driver.
"""

__version__ = "0.1.0"
