"""Training-data operators: cleaning, deduplication, mixing, tokenizing, sharding and formatting at corpus scale.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries if it is present.
"""
