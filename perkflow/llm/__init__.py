"""Training-data operators: quality, repetition, tokenizing, chat, packing, pages, vectors, near-dups, urls.

Nothing else in the library imports this subpackage; its registered queries
live in ``perkflow.llm.queries``.
"""
