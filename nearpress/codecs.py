"""Compressors: how many bytes a text takes.

A codec is an object with ``size(data: bytes) -> int``; ``register_codec``
makes a factory known by a name, so that specs like ``("zstd", {"quality":
18})`` can be sent to workers.  Encoders are made once for a worker.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol


class Codec(Protocol):
    def size(self, data: bytes) -> int: ...


class Zstd:
    """Zstandard, as a stream of unknown length.

    A one-shot call picks other parameters from the known size and gives other
    sizes, so the streaming interface is used; the context is kept.
    """

    def __init__(self, quality: int = 18):
        if not 0 <= quality <= 22:
            raise ValueError(f"zstd quality is 0 to 22, not {quality}")
        import zstandard

        self._encoder = zstandard.ZstdCompressor(level=quality)

    def size(self, data: bytes) -> int:
        stream = self._encoder.compressobj()
        return len(stream.compress(data)) + len(stream.flush())


@lru_cache(maxsize=1)
def _brotli():
    for name in (ctypes.util.find_library("brotlienc"), "libbrotlienc.so.1"):
        try:
            if name:
                lib = ctypes.CDLL(name)
                break
        except OSError:
            continue
    else:
        return None
    size_t, pointer = ctypes.c_size_t, ctypes.c_void_p
    lib.BrotliEncoderCreateInstance.restype = pointer
    lib.BrotliEncoderCreateInstance.argtypes = [pointer, pointer, pointer]
    lib.BrotliEncoderSetParameter.argtypes = [pointer, ctypes.c_int, ctypes.c_uint32]
    lib.BrotliEncoderCompressStream.argtypes = [pointer, ctypes.c_int] + [pointer] * 5
    lib.BrotliEncoderCompressStream.restype = ctypes.c_int
    lib.BrotliEncoderIsFinished.argtypes = [pointer]
    lib.BrotliEncoderIsFinished.restype = ctypes.c_int
    lib.BrotliEncoderDestroyInstance.argtypes = [pointer]
    lib.BrotliEncoderCompress.argtypes = [ctypes.c_int] * 3 + [size_t, ctypes.c_char_p] + [pointer] * 2
    lib.BrotliEncoderCompress.restype = ctypes.c_int
    lib.BrotliEncoderMaxCompressedSize.argtypes = [size_t]
    lib.BrotliEncoderMaxCompressedSize.restype = size_t
    return lib


class Brotli:
    """Brotli, in one write of the whole text.

    ``quality`` is 0 to 11 and ``lg_window_size`` 10 to 24.  Without the system
    library pyarrow's codec is used, which takes the quality only.
    """

    _QUALITY, _LG_WINDOW, _FINISH = 1, 2, 2
    _SHORT = 60_000

    def __init__(self, quality: int = 5, lg_window_size: int = 21):
        if not 0 <= quality <= 11 or not 10 <= lg_window_size <= 24:
            raise ValueError(f"brotli takes quality 0 to 11 and window 10 to 24, not {quality} and {lg_window_size}")
        self.quality, self.lg_window_size = quality, lg_window_size
        self._lib = _brotli()
        if self._lib is None:
            import warnings

            import pyarrow as pa

            warnings.warn("libbrotlienc isn't there; the window size isn't used", stacklevel=2)
            self._codec = pa.Codec("brotli", compression_level=quality)
        self._room = ctypes.create_string_buffer(1 << 16)
        self._n = ctypes.c_size_t()

    def size(self, data: bytes) -> int:
        lib = self._lib
        if lib is None:
            return len(self._codec.compress(data, asbytes=True))
        # one call for short texts; quality 10 and what doesn't get smaller take another way there
        if len(data) <= self._SHORT and self.quality != 10:
            self._n.value = len(self._room)
            if lib.BrotliEncoderCompress(self.quality, self.lg_window_size, 0, len(data), data, ctypes.addressof(self._n), ctypes.addressof(self._room)) and self._n.value <= len(data):
                return self._n.value
        return self._streamed(data)

    def _streamed(self, data: bytes) -> int:
        lib = self._lib
        state = lib.BrotliEncoderCreateInstance(None, None, None)
        try:
            lib.BrotliEncoderSetParameter(state, self._QUALITY, self.quality)
            lib.BrotliEncoderSetParameter(state, self._LG_WINDOW, self.lg_window_size)
            left, total = ctypes.c_size_t(len(data)), 0
            source = ctypes.c_char_p(data)
            at = ctypes.c_void_p(ctypes.cast(source, ctypes.c_void_p).value)
            while True:
                free = ctypes.c_size_t(len(self._room))
                out = ctypes.c_void_p(ctypes.addressof(self._room))
                if not lib.BrotliEncoderCompressStream(state, self._FINISH, ctypes.byref(left), ctypes.byref(at), ctypes.byref(free), ctypes.byref(out), None):
                    raise RuntimeError("brotli failed")
                total += len(self._room) - free.value
                if lib.BrotliEncoderIsFinished(state):
                    return total
        finally:
            lib.BrotliEncoderDestroyInstance(state)


class TokenSet:
    """A stand-in for tests: the number of distinct pieces between spaces.

    Unlike a real codec it has a symmetric union, for which the distance is a
    metric, and SQL can express it.
    """

    def size(self, data: bytes) -> int:
        return len({t for t in data.split(b" ") if t})


_FACTORIES: dict[str, Callable[..., Codec]] = {}

#: Presets by name.
PRESETS: dict[str, tuple[str, dict]] = {
    "brotli_recommended": ("brotli", {"quality": 5, "lg_window_size": 21}),
    "brotli_max": ("brotli", {"quality": 11, "lg_window_size": 24}),
    "zstd_recommended": ("zstd", {"quality": 18}),
    "zstd_max": ("zstd", {"quality": 22}),
}


def register_codec(name: str, factory: Callable[..., Codec]) -> None:
    """Makes a codec known; the factory has to be importable on the workers."""
    _FACTORIES[name] = factory


for _name, _factory in (("zstd", Zstd), ("brotli", Brotli), ("tokenset", TokenSet)):
    register_codec(_name, _factory)


class Spec:
    """A codec by name and parameters; small, and the same on every worker."""

    def __init__(self, name: str = "brotli_recommended", **params: int):
        if name in PRESETS:
            base, preset = PRESETS[name]
            name, params = base, preset | params
        if name not in _FACTORIES:
            raise ValueError(f"unknown codec {name}; there are {', '.join(sorted(_FACTORIES))}")
        self.name, self.params, self.factory = name, params, _FACTORIES[name]
        self.make()  # wrong parameters fail here, not on a worker

    def make(self) -> Codec:
        return _made(self.factory, tuple(sorted(self.params.items())))

    def __reduce__(self):
        return _restore, (self.name, self.params, self.factory)


@lru_cache(maxsize=256)
def _made(factory: Callable[..., Codec], params: tuple) -> Codec:
    return factory(**dict(params))


def _restore(name: str, params: dict, factory: Callable[..., Codec]) -> Spec:
    register_codec(name, factory)
    return Spec(name, **params)
