"""Seeds derived from labels, the same on every machine."""

from __future__ import annotations

import hashlib

import numpy as np

from panelforge.params import SEED


def derive_seed(label: str, master: int = SEED) -> int:
    """64 bits of BLAKE2b over "{master}:{label}", modulo 2**32."""
    digest = hashlib.blake2b(f"{master}:{label}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") % 2**32


def rng(label: str, master: int = SEED) -> np.random.Generator:
    return np.random.default_rng(derive_seed(label, master))
