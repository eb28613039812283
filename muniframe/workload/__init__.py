"""The operators applied to the driver tables, each with an equivalent SQL text."""
