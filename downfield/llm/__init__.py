"""Training-data operators: scoring, deduplication, mixing, formatting and binary output.

Nothing outside this folder (but ``corpus_pipeline.py``) imports it.
"""
