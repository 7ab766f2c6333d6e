"""Errors with stable codes."""


class EngineError(Exception):
    code = "ENGINE"


class Refused(EngineError):
    """A statement or declaration that the engine does not run."""

    code = "REFUSED"


class Withheld(EngineError):
    """A policy decision that failed; the message never quotes a value."""

    code = "WITHHELD"


class Guardrail(EngineError):
    """A cross-source plan that a declared limit rules out before anything runs."""

    code = "GUARDRAIL"


class LateRow(EngineError):
    code = "LATE_ROW"
