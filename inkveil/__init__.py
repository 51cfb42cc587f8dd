"""inkveil: finding, classifying and redacting personal data in Dutch public documents, on Spark."""
