"""Composed operators: converters, prompts, evaluation, pipelines, and the query list."""
