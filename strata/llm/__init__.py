"""Training-data operators for text corpora.

Nothing outside this subpackage imports it; its queries and their SQL are in
``strata.llm.queries``.
"""
