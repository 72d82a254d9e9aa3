"""The function library: 64-world counters, their noise, masks over worlds and Laplace noise.

Every function gives a Column of built-in expressions, so it stays in the JVM; only the popcount repair
of hashes and the sequential posterior (see noise.release_tracked) are vectorised Python.
"""

from .hashing import key_hash as key_hash_column
from .hashing import pac_hash, pu_hash
from .noise import dp_laplace_noise, pac_finalize, pac_noised
from .worlds import *  # noqa: F403
from .worlds import __all__ as _worlds

__all__ = ["pac_hash", "pu_hash", "key_hash_column", "dp_laplace_noise", "pac_finalize", "pac_noised", *_worlds]
