"""Errors of the collection API."""


class MeridianError(Exception):
    """Base of all."""


class NotFound(MeridianError):
    """No such collection."""


class AlreadyExists(MeridianError):
    """The collection exists; its schema stays as it is."""


class InvalidArgument(MeridianError, ValueError):
    """A request that no state could satisfy."""


class Unavailable(MeridianError):
    """Too few replicas answered."""


class FailedPrecondition(MeridianError):
    """The membership does not allow the change."""
