"""Training-data operators: each module is one operator with its own interface.

Nothing outside this subpackage imports it; ``llm.registry`` names its queries.
"""
