"""Training-data operators: tokens, search, scores, joins, scans and mixing.

Nothing outside this subpackage imports it.
"""
