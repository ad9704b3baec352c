"""The engine's queries over the shared test tables, each with an independent SQL twin."""
