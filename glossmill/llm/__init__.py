"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  ``registry`` lists its queries and
their SQL; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
