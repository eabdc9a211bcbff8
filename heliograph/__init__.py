"""Heliograph: a Spark-first hybrid recall and corpus analytics engine.

Everything relational is a DataFrame/SQL plan; subpackages:

* ``functions``  scalar building blocks (tokenizers, hashing, truncation, vectors)
* ``operators``  relational operators (BM25, vector top-k, fusion, diversify, metrics, ...)
* ``sources``    readers, writers and the Parquet-backed store
* ``plans``      composed end-to-end queries (recall, code recall, context, evaluation)
* ``streaming``  Structured Streaming versions of the capture path
"""

__version__ = "0.1.0"
