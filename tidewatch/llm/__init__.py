"""Operators for building training corpora.

Nothing outside this subpackage imports it; its queries are in
``tidewatch.llm.queries`` and are added to the entry module only when the
subpackage is present.
"""
