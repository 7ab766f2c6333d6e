"""Imports every module that registers queries."""

from . import emulated, policies, relational, views  # noqa: F401
