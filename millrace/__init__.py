"""Millrace: turns collections of pages, documents and model outputs into structured tables on Spark."""
