"""Operators for preparing training data: documents, token ids, conversations, web pages."""
