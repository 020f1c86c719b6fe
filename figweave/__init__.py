"""figweave: analytics over extracted-document tables, as Spark DataFrame operators."""
