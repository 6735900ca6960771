"""Queries of this subpackage and the SQL that they are held against."""

from importlib import import_module

import corpus_pipeline

#: One module per operator; each has NAME, query(spark, sf_dir) and, where SQL can express it, ORACLE.
OPERATORS = ("html_extract", "quality_rules", "sharding", "fingerprints", "simhash", "packing", "mixing", "token_counts", "chat_format", "warc", "merkle", "credentials", "alignment")


def _modules():
    return [import_module(f"sparsefold.llm.{name}") for name in OPERATORS]


def queries():
    return {m.NAME: m.query for m in _modules()} | {"pipeline": corpus_pipeline.run}


def oracles():
    found = {m.NAME: m.ORACLE for m in _modules() if getattr(m, "ORACLE", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
