"""Span labelling, dataset curation and detector evaluation on Spark."""
