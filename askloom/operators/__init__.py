"""Operators over tables: chunking, indexes, ranking, contexts, answers, evaluation."""
