"""Spark-first analytics over batches of model trajectories and their datasets."""
