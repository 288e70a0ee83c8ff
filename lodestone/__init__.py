"""Lodestone: a Spark-native engine for searchable, rebuildable text memories.

Markdown becomes sections, sections become size-bounded chunks, chunks become
vector and inverted-index tables, and batches of questions are answered by one
lazy plan.  Every operator maps DataFrames to DataFrames.
"""

__version__ = "0.1.0"
