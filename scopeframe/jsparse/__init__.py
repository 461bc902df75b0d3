"""A JavaScript parser and scope analysis in plain Python, without dependencies."""

from .lexer import ParseError
from .scope import Analysis, analyse

__all__ = ["Analysis", "ParseError", "analyse"]
