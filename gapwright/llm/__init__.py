"""Training-data operators over text, page and vector tables.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries.  Nothing outside this subpackage imports it.
"""
