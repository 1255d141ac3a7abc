"""Exceptions raised while a comparison is being planned."""


class ComparisonError(ValueError):
    """A comparison cannot be planned with the given inputs."""


class DuplicateKeyError(ComparisonError):
    """The columns given as primary key do not identify single rows."""

    def __init__(self, key, base_duplicates, current_duplicates):
        self.key = list(key)
        self.base_duplicates = base_duplicates
        self.current_duplicates = current_duplicates
        super().__init__(
            f"Primary key {self.key} is not unique: {base_duplicates} duplicated key(s) in base, "
            f"{current_duplicates} in current"
        )


class UnsupportedTypeError(ComparisonError):
    """The column type has no meaning for the requested operator."""
