"""Training-data operators over text corpora (documents, pages, benchmark, labels).

Nothing outside this subpackage imports it; its queries live in :mod:`gridspark.llm.queries`.
"""
