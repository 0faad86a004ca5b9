"""Readers, writers and the schemas of the tables the engine works on."""
