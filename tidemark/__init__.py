"""tidemark: data observability and table upkeep as Spark DataFrame plans."""
