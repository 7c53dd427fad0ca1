"""The queries of this package; importing the modules registers them."""

from . import ann, bpe, hardneg, licenses, lmscore, mixing, nearvectors, secrets, simhash, spelling, suffixes, tokens, toxicity  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
