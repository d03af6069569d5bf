"""Operators: documents, relationship discovery, retrieval, judgement, graph and exploration."""
