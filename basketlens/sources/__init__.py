from basketlens.sources import retail, tables  # noqa: F401
