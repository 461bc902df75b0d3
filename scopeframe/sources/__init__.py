"""Sources and sinks: files, plain text, inline scripts of stored pages."""

from .files import read_files, read_text, write_files
from .scripts import inline_scripts

__all__ = ["inline_scripts", "read_files", "read_text", "write_files"]
