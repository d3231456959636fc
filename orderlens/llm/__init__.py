"""Operations of a training-data pipeline over a table of documents.

Nothing outside this package imports it. ``queries`` holds its named queries
and their SQL.
"""
