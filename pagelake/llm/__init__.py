"""Operators that prepare text collections for training language models.

Each module is one operator on a table of documents (``doc_id`` bigint, ``text`` string; URLs
for ``url_filter``). Operators read only the columns they name, so further columns of any
name do no harm. ``queries`` holds the registered queries and their SQL twins.
"""
