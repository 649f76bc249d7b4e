"""tidemark: lineage, data-quality rules and checks as Spark DataFrame operators."""
