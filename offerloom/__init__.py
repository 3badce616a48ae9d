"""offerloom: catalogue comparison and corpus preparation as Spark DataFrame jobs."""
