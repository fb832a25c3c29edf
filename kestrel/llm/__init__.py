"""Operators of a training-data pipeline: language ID, line dedup, mixing,
decontamination, near-dedup, toxicity, HTML extraction, quality, WARC.

`queries.py` registers one query per operator; nothing else in the library
imports this subpackage.
"""
