"""Training-data operators: search, sharding, cleaning, packing and scoring of documents.

Nothing else in the package imports this subpackage.
"""
