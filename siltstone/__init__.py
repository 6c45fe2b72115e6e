"""siltstone: build, search and measure a governed document index with Spark."""
