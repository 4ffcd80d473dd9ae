"""Operators of a training-data pipeline over documents (doc_id, text, ...).

Nothing else in the library imports this package.  Python inside tasks works on
Arrow batches; Spark partitions, shuffles, joins and aggregates.
"""
