"""Training-data operators: packing, quality, near-duplicates, language, HTML, BPE, WARC, search.

Nothing outside this subpackage imports it.
"""
