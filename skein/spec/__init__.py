"""Declarative adapters: YAML specs compiled to DataFrame plans."""
