"""Token ids of whole texts, by a public tokenizer's file.

`Encoder` gives the ids that the tokenizers library gives for a whole text, as little-endian unsigned
32-bit integers. Where the tokenizer's file says that pieces are encoded apart from each other (it
splits at white space and between letters and other characters), pieces already met are remembered, and
the library is asked for the others only; else it is given whole texts. What is remembered is bounded
by MEMORY bytes in a Python process, however long pieces are: forgetting costs time but changes no id.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

MEMORY = 80_000_000  # bytes that all remembered pieces of a process may take
LONGEST = 64  # code points of a piece that is remembered
ENTRY = 170  # bytes of an entry beside its characters and ids: two objects and their place in the table
DOOR = 1 << 20  # places to note that a piece was met once

# Texts of these characters alone are lowered as a whole and cut into runs of letters and runs of others: their lower case is the same in any context, nothing in them composes, and no contraction or special
# token is among them. Of the code page 1252, which has them all.
_PLAIN = bytes({*b"\t\n\x0b\x0c\r", *range(0x20, 0x27), *range(0x28, 0x7F), 0x8C, 0x9C, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)})
_LETTERS = re.compile("[a-zß-öø-ÿœ]+")
# Lower case by byte, and what a byte is then: 0 white space, 1 a letter, 2 another character.
_LOWER = bytes(b + 32 if b in range(0x41, 0x5B) or b in range(0xC0, 0xDF) and b != 0xD7 else 0x9C if b == 0x8C else b for b in range(256))
_CLASS = np.array([0 if b in b"\t\n\x0b\x0c\r " else 1 if b in range(0x61, 0x7B) or b in range(0xDF, 0x100) and b != 0xF7 or b == 0x9C else 2 for b in range(256)], dtype=np.uint8)
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python only


def plain(text: str) -> bytes | None:
    """The bytes of a text of these characters alone; None of any other."""
    try:
        raw = text.encode("ascii" if text.isascii() else "cp1252")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _PLAIN) or b"<|" in raw else raw


def runs(raw: bytes) -> list[str]:
    """The runs of letters and runs of others of a plain text, lowered: a space is put in where one follows the other."""
    raw = raw.translate(_LOWER)
    data = np.frombuffer(raw, dtype=np.uint8)
    kinds = _CLASS[data]
    meet = (kinds[1:] ^ kinds[:-1]) == 3
    at = np.flatnonzero(meet)
    if len(at):
        # the i-th space stands i places further than the byte that it follows
        spaced = np.ones(len(data) + len(at), dtype=bool)
        spaced[at + np.arange(1, len(at) + 1)] = False
        put = np.full(len(spaced), 0x20, dtype=np.uint8)
        put[spaced] = data
        raw = put.tobytes()
    return raw.decode("cp1252" if b"\x9c" in raw else "latin-1").split()  # alike but for this letter; the latter is faster


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def apart(definition: dict) -> bool:
    """Whether runs of letters, runs of others and spaces are encoded apart, by the tokenizer's file."""
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = [n.get("type") for n in (definition.get("normalizer") or {}).get("normalizers") or []]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    return (
        steps[0].get("type") == "Split"
        and bool(steps[0].get("invert"))
        and steps[0].get("behavior") == "Removed"
        and r"|[\p{L}]+|" in pattern
        and pattern.endswith(r"[^\s\p{L}\p{N}]+")
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
        and not steps[1].get("add_prefix_space")
        and normal == ["NFC", "Replace", "Lowercase"]
        and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in definition.get("added_tokens", []))
    )


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Memory(dict):
    """Pieces and their ids in two generations: when the young one is full, it becomes the old one.

    What is met again while it is old becomes young, so common pieces are never forgotten. Most pieces are met
    once: one is remembered when it is met again, of which a table of DOOR bytes keeps note.
    """

    def __init__(self, ask) -> None:
        super().__init__()
        self.ask, self.limit = ask, MEMORY // 2
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.met = bytearray(DOOR)

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.ask(piece)
            place = hash(piece) & DOOR - 1
            if not self.met[place] or len(piece) > LONGEST:
                self.met[place] = 1
                return found
        if self.size >= self.limit:
            self.old, self.size, self.met = dict(self), 0, bytearray(DOOR)
            self.clear()
        self[piece] = found
        self.size += ENTRY + 2 * len(piece) + len(found)
        return found


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.apart = apart(json.load(f))
        self.model = self.library.model
        self.letters = _byte_letters()
        self.known = _Memory(self._ask)

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ask(self, piece: str) -> bytes:
        """The ids of a piece by itself; the model is asked at once for letters that nothing would change."""
        if _LETTERS.fullmatch(piece) is None:
            return self._whole(piece)
        if not piece.isascii():
            piece = "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.apart:
            return self._whole(text)
        raw = plain(text)
        if raw is not None:
            return b"".join(map(self.known.__getitem__, runs(raw)))
        if _SEPARATORS.search(text):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
