"""meshlens: set-based code-corpus and service-graph analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing is answered one
entity at a time.  Sub-packages:

* ``sources``   – table loading, probe views, sinks
* ``functions`` – scalar ``Column`` expressions (normalizers, scores, masks)
* ``operators`` – relational / text / graph / search operators
* ``plans``     – the registered query catalog and its DuckDB oracle text
* ``streaming`` – incremental refresh and Structured Streaming jobs
"""

__version__ = "0.1.0"
