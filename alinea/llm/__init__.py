"""Operators for training data. Nothing outside this subpackage imports it."""

#: Modules that register queries.
QUERY_MODULES = [f"alinea.llm.{m}" for m in ("sampling", "confusables", "topn", "encoding", "packing", "pieces")]
