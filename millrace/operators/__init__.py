"""Operators on DataFrames: batches, samples, groups, advantages, losses, balance, scores."""
