"""crosstide: multi-factor long/short equity research as Spark DataFrame jobs."""
