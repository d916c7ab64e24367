"""Column functions over text and vectors: built-in expressions only, no Python in the plan."""
