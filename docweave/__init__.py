"""docweave: a PySpark-native engine for document evidence.

Everything is a DataFrame-in, DataFrame-out function.  The subpackages:

* ``sources``    table readers, nested evidence readers, sinks
* ``functions``  column functions (text, normalisation, geometry, ids)
* ``operators``  relational building blocks (ranking, joins, islands, metrics ...)
* ``plans``      multi-operator plans (extraction, evaluation, shredding)
* ``streaming``  Structured Streaming jobs
* ``queries``    the named queries the entry point registers
* ``llm``        operators for preparing training data (optional, nothing else imports it)
"""

__version__ = "0.1.0"
