"""Errors that a statement can end with."""

from __future__ import annotations


class GqlError(ValueError):
    """A statement that is wrong; the text says where when that is known."""

    def __init__(self, message: str, at: tuple[int, int] | None = None):
        super().__init__(f"{message} (line {at[0]}, column {at[1]})" if at else message)
        self.at = at


def unsupported(what: str, at: tuple[int, int] | None = None) -> GqlError:
    return GqlError(f"GQL feature not implemented: {what}", at)
