"""One exception class; the code tells what kind of failure it is."""

from __future__ import annotations


class AvroError(Exception):
    """code is "invalid" (bad input), "precondition" (wrong type or state), "missing" or "range" (end of data)."""

    def __init__(self, message: str, code: str = "invalid"):
        super().__init__(message)
        self.code = code

    def __reduce__(self):
        return (AvroError, (str(self), self.code))
