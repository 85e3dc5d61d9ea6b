"""Nothing here runs as a stream of its own: all inputs of these checks are whole tables.

The row-wise operators need no state and no shuffle, so they take a streaming DataFrame as it
is: ``operators.comments.categorize_comments``, ``operators.responses.read_responses`` and
``parse_kpi_responses``, and every step column of ``operators.metadata``.
"""
