"""docweave: schemaless JSON documents to typed relational tables, on Spark."""
