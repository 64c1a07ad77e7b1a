"""Preparation of text for language models. Nothing else in tidemark imports this subpackage."""
