"""A folder watched for sources."""

from .watch import watch

__all__ = ["watch"]
