"""Training-data operators: tokenising, scoring, linking, formatting and mixing of a text corpus."""
