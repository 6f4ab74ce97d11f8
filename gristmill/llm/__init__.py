"""Operators for preparing language-model training corpora.

Nothing else in the package imports this subpackage; its queries are listed in
``queries.py`` and are added to the entry file only when it can be imported.
"""
