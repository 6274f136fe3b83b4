"""Registered queries; importing this package registers them all."""

from . import cleaning, corpus, detection, models, names, punkt, vectors, web  # noqa: F401
