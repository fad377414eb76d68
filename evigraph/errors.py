"""Typed errors; a request outside the bounded surface is refused, never answered with nothing."""


class EvigraphError(Exception):
    """Root of all errors of this package."""


class ParseError(EvigraphError):
    """The text isn't in the language."""


class Unsupported(ParseError):
    """The text is in the wider language, but outside the bounded surface."""


class InvalidRequest(EvigraphError):
    """A request breaks a limit or a rule on its shape."""


class BudgetExceeded(EvigraphError):
    """More rows than the request allows would be needed; nothing partial is returned."""


class Conflict(EvigraphError):
    """A revision, identity or idempotency key doesn't match what is stored."""


class NotFound(EvigraphError):
    """No such record, or none that the caller may see."""


class AmbiguousSeed(EvigraphError):
    """Seeds at the boundary of the selection can't be told apart by score."""
