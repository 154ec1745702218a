"""Imports every catalog module so that its queries register."""

from catalog import detection, digital, files, fitting, learning, signals, streams  # noqa: F401
