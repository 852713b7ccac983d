"""Operators of a training-data pipeline: text, pages, vectors, conversations.

Nothing else in the library imports this folder. Each module holds one operator with its own
general interface; ``queries`` derives the registered results from them.
"""
