"""Operations of a training-data pipeline over large text tables.

Nothing outside this folder imports it. ``queries.QUERIES`` binds each operation to the supplied
tables and ``queries.SQL`` states the same results as SQL where SQL can.
"""
