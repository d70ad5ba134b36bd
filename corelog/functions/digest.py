"""SHA-256 whose state goes from one process to the next; hashlib's can't be taken out of its process."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib

#: Bytes of OpenSSL's public structure SHA256_CTX: eight words of state, two of length, 64 bytes of data, two integers.
CONTEXT_BYTES = 112


@functools.cache
def _libcrypto():
    """The libcrypto that hashlib stands on, else the system's, if it digests as hashlib does; else None."""
    try:
        import _hashlib

        paths = [getattr(_hashlib, "__file__", None)]
    except ImportError:
        paths = []
    for path in [*paths, ctypes.util.find_library("crypto")]:
        try:
            lib = ctypes.CDLL(path) if path else None
            if lib and _agrees(lib):
                return lib
        except (OSError, AttributeError):
            continue
    return None


def _agrees(lib) -> bool:
    data, digest = bytes(range(256)), Digest(lib=lib)
    digest.update(data[:100])
    digest = Digest(digest.state(), lib=lib)
    digest.update(data[100:])
    return digest.hexdigest() == hashlib.sha256(data).hexdigest()


def can_carry() -> bool:
    """Whether this process can carry a state: it needs a libcrypto."""
    return _libcrypto() is not None


class Digest:
    """As hashlib.sha256(); state() of one goes into another, here or elsewhere."""

    def __init__(self, state: bytes | None = None, *, lib=None):
        self._lib = lib or _libcrypto()
        self._context = ctypes.create_string_buffer(state or b"", CONTEXT_BYTES)
        if state is None:
            self._lib.SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        self._lib.SHA256_Update(self._context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        """Of what came so far; more may follow."""
        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state(), CONTEXT_BYTES)
        self._lib.SHA256_Final(out, end)
        return out.raw.hex()
