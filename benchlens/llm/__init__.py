"""Operators for large text corpora: formatting, search, classifiers, dedup, encoding, packing.

Nothing else in the library imports this subpackage. Queries and their SQL are
in ``benchlens.llm.queries``; the staged corpus pipeline is ``corpus_pipeline.py``
at the repository top.
"""
