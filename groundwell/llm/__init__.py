"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``queries`` lists the ten registered
queries, and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
