"""Training-data operators: chat formatting, vector search, deduplication,
packing, quality, token files, decontamination and archives.

Nothing else in the library imports this subpackage.
"""
