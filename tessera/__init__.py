"""tessera: structural-code analytics and snapshot processing as Spark plans."""
