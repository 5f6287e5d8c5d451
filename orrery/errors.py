"""Errors of the engine; all are ValueErrors."""


class CoordinateError(ValueError):
    """Inputs of a projection or search don't fit each other."""


class ReplayError(ValueError):
    """Stored evidence is missing, malformed or not what its hashes say."""


class ArtifactError(ValueError):
    """A projection can't be exported as verified."""
