"""Search plans and the query registry."""
