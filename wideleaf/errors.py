"""Error classes of the dialect."""


class WideleafError(Exception):
    """Base of all errors raised here."""


class InvalidArgument(WideleafError):
    """A request that can never be served."""


class NotFound(WideleafError):
    """A table, family or view that isn't there."""


class PermissionDenied(WideleafError):
    """A write outside of what a view allows."""


class AlreadyExists(WideleafError):
    """A name that is taken."""


class FailedPrecondition(WideleafError):
    """A request that the present state doesn't allow."""


class OutOfRange(WideleafError):
    """A place or time beyond what is kept."""


class Unimplemented(WideleafError):
    """Known, but not offered."""


class EvalError(WideleafError):
    """An error of evaluation, which SAFE and IFERROR absorb."""
