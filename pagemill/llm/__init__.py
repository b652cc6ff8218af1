"""Training-data operators over the ``documents``, ``pages``, ``benchmark`` and ``labels`` tables.

Nothing outside this subpackage imports it; its queries are listed in :mod:`pagemill.llm.queries`.
"""
