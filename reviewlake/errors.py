"""Errors raised while a plan is being built, before any job runs."""


class DatasetError(ValueError):
    """A dataset, table or column cannot answer the question that was asked."""


class MissingTableError(FileNotFoundError):
    """A layer table that a build step needs has not been written yet."""
