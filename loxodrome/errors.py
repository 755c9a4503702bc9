"""Typed errors: each carries an identifier of the form area:Reason."""


class GeoError(ValueError):
    def __init__(self, identifier: str, message: str = "") -> None:
        super().__init__(f"{identifier}: {message}" if message else identifier)
        self.identifier = identifier


class GeoWarning(UserWarning):
    def __init__(self, identifier: str, message: str = "") -> None:
        super().__init__(f"{identifier}: {message}" if message else identifier)
        self.identifier = identifier
