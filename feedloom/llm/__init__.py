"""Operators for preparing training text: compression, classifiers, quality rules, duplicates, mixing."""
