"""Case-file text and entity analytics as Spark jobs, with operators for training-data pipelines."""
