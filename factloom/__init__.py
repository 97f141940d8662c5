"""factloom: knowledge-base analytics expressed as Spark DataFrame plans."""
