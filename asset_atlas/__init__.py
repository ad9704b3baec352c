"""Catalogue of image assets and style literals, built from Spark DataFrame operators."""
