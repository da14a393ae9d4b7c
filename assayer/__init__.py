"""assayer: evidence audits and experiment verdicts as Spark DataFrame programs."""
