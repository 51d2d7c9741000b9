"""quire — Spark-native archive analytics.

Batch DataFrame jobs over tables of archived web pages: catalogue, redirect
resolution, HTML-to-relations extraction, chunking with a section index,
paged title search and an incremental render cache.
"""

__version__ = "0.1.0"
