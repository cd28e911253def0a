"""A PySpark engine for document decisions: text understanding, validation, scoring, linking, voting and evaluation."""
