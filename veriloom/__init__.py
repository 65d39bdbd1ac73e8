"""Part of the document-checking engine."""
