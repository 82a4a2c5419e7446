"""Operators for preparing language-model training data.

Ten operators (one module each), their registered queries (:mod:`.queries`) and
shared helpers (:mod:`.common`). Nothing outside this folder imports it.
"""
