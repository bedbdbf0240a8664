"""Scriptorium: document and translation-QA analytics as Spark DataFrame operators."""
