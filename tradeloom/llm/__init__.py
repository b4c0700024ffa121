"""Training-data operators: near-duplicate search, scoring, mixing, packing, archives and rendering.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
