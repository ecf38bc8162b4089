"""Conversation and meeting corpora as Spark tables, with corpus-scale operators over them."""
