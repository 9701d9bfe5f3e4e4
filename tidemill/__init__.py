"""tidemill: lakehouse analytics expressed as Spark DataFrame plans."""
