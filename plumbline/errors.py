"""What the tools raise, and the exit codes that command lines give them."""

from __future__ import annotations


class DigestError(Exception):
    """Base of the library's errors."""

    exit_code = 1


class BadInput(DigestError, ValueError):
    """An input of the wrong kind, or options that exclude each other."""


class NotFound(DigestError, FileNotFoundError):
    """A path, table or manifest that isn't there."""

    exit_code = 3


class MissingDependency(DigestError, ImportError):
    """A format whose reader needs a package that isn't installed."""

    exit_code = 2

    def __init__(self, package: str, purpose: str):
        super().__init__(f"{purpose} needs the package {package}, which isn't installed")


class FetchError(DigestError):
    """A page that couldn't be fetched; the network is out of the library's reach."""


class WrongContentType(FetchError):
    """A response that isn't text."""


class GitError(DigestError):
    """A git command that failed, or a folder outside any repository."""

    exit_code = 4
