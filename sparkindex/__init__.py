"""sparkindex: code-index analytics as ordinary Spark DataFrame plans."""
