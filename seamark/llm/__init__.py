"""Training-data operators: filters, scans, joins, classifiers and counters over whole corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
