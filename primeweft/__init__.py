"""In-silico PCR over many assemblies as Spark DataFrame plans."""
