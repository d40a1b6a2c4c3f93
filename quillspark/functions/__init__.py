"""Column functions: text keys, similarity, model output and rules."""
