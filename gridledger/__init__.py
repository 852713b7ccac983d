"""Grade and analyse a corpus of spreadsheet models and their run logs with Spark."""
