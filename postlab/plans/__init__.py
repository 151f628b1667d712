"""Compositions of operators: the query catalogue, its SQL oracle and the whole pipeline."""
