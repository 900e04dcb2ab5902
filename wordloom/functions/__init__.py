"""Column functions: native text operators, exact state machines, character ids and vectors."""
