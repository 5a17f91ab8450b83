"""tidemark: change-evidence analytics as Spark plans."""
