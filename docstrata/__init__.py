"""docstrata: document-corpus analytics expressed as Spark DataFrame operators."""
