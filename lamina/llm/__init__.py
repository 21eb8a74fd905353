"""Training-data operators over text tables.

Nothing else in the package imports this subpackage; ``queries.py`` holds the
``opN_*`` registrations and their SQL, ``corpus_pipeline.py`` at the repository
top chains five of the operators.
"""
