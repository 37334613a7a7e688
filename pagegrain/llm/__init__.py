"""Training-data operators: scoring, filtering, joining, packing and materialising text corpora.

Nothing else in the package imports this subpackage; ``registry`` lists its queries.
"""
