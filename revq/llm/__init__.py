"""Operators for preparing training text: one module per operator.

Nothing else in the library imports this package; ``llm.queries`` holds the
registered queries and their SQL, ``corpus_pipeline.py`` chains five of them.
"""
