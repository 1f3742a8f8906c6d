"""qscore: quality scoring of very large code and text collections on Spark."""
