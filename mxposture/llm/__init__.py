"""Operators for preparing language-model training text; see the module of each operator."""
