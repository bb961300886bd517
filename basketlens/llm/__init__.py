"""Training-data operators (quality, language, secrets, duplicates, mixing, scoring, output formats).

Nothing else in the library imports this subpackage.
"""
