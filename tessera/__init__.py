"""tessera: document collections to a schema-checked property graph, on Spark."""
