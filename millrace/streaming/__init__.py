"""State that is carried over micro-batches."""
