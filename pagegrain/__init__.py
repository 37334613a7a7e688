"""Visual-document retrieval, region relevance and evaluation as DataFrame plans."""
