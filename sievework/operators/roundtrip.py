"""What normalisation (X12) makes of perturbed texts (P01), judged where the texts are read.

As columns, nine normal forms a text are well over a hundred passes over it. Here a text is UTF-8 bytes and a step one call of
a built-in function, skipped where the text has no byte that can take part in it. Only texts on which all engines agree
are judged here: characters of the first plane that Unicode 3.2 had, and pictures; no backspaces, nothing that may be Base64 or hex, escapes that
are all well-formed. The others are handed back, for the columns of ``functions.text`` that say what the normal form is."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from ..functions.text import ENGLISH, HOMOGLYPHS, INVISIBLE, LOWER, ROT, UPPER

SCHEMA = "perturbation string, n bigint, recovered bigint, text string"


class Odd(Exception):
    """A text that the columns judge."""


def _points(kept) -> str:
    """A character class of the first plane's code points that are ``kept``."""
    flags = np.array([False, *(kept(chr(c)) for c in range(0x10000)), False])
    ends = np.flatnonzero(flags[1:] != flags[:-1]).reshape(-1, 2)
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in ends)


def _settled_class(c: str) -> bool:
    """Of the same class in Unicode 3.2 and now. The two signs that become a letter of a-z only in lower case are left out."""
    kind = unicodedata.category(c)
    return c not in "\b\u0130\u212a" and kind not in ("Cn", "Cs") and kind == unicodedata.ucd_3_2_0.category(c)


def _table(old: str, new: str) -> bytes:
    return bytes.maketrans(old.encode(), new.encode())


def _leads(chars) -> dict[bytes, set[bytes]]:
    """The second bytes of these characters by the first."""
    out = defaultdict(set)
    for c in chars:
        out[c.encode()[:1]].add(c.encode()[1:2])
    return dict(out)


def _may_have(t: bytes, leads: dict[bytes, set[bytes]]) -> bool:
    return not t.isascii() and any(a in t and any(b in t and a + b in t for b in more) for a, more in leads.items())


# Fixed value: a block of pictures, whole since Unicode 8.
PICTURES = "\U0001f300-\U0001f64f"
ODD = re.compile(f"[^{_points(_settled_class)}{PICTURES}]")
MARKS = re.compile(f"[{_points(lambda c: unicodedata.category(c) in ('Mn', 'Mc'))}]")
SIGNS = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), INVISIBLE))
ZERO_WIDTH = "\u200b".encode()
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN = re.compile(rb"[^A-Za-z0-9+/=\t-\r \xc2\xe1-\xe3\x80-\xbf]")  # a byte that no coded text and no white space has
CODED = re.compile(f"[A-Za-z0-9+/={WHITE}]*+")
ESCAPE = re.compile(rb"%[0-9A-Fa-f]{2}")
FOLD = str.maketrans(*HOMOGLYPHS)
# Bytes of ASCII, those that continue a character, and first ones whose characters no step after decoding changes.
_firsts = defaultdict(list)
for _c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
    _firsts[_c.encode()[0]].append(_c)
_kept = lambda c: not (ODD.match(c) or MARKS.match(c) or c in HOMOGLYPHS[0] or unicodedata.normalize("NFKC", c) != c)
INERT = bytes([*range(0xC0), *(b for b, cs in _firsts.items() if all(map(_kept, cs)))])
_every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000), *range(0xE0000, 0xE1000)]))
SIGN_LEADS, MARK_LEADS, FOLD_LEADS = (_leads(c) for c in (SIGNS.findall(_every), MARKS.findall(_every), HOMOGLYPHS[0]))
del _every, _firsts, _kept, _c
ROTATE = _table(LOWER + UPPER, ROT + ROT.upper())
BLANK = _table("\t\n\x0b\f\r", " " * 5)
LEET = _table("aeiost", "431057")
WORDS = bytes(c | 32 if chr(c) in LOWER + UPPER else 32 for c in range(256))
# What a word adds to the markers of the rotated text over those of the text.
MARKERS, TURNS = {w.encode() for w in ENGLISH}, {w.encode().translate(ROTATE) for w in ENGLISH}
GAIN = dict.fromkeys(TURNS - MARKERS, 1) | dict.fromkeys(MARKERS - TURNS, -1)
CONTROLS, CONTINUED, LOOSE = bytes([*range(32), 127]), bytes(range(0xC0)), bytes([*b" \t\n\x0b\f\r", *range(0x80, 0x100)])
HEX = np.array([int(chr(c), 16) if chr(c) in "0123456789ABCDEFabcdef" else 16 for c in range(256)], np.uint8)
GONE = 0xFF  # no byte of UTF-8


def _plausible(t: bytes) -> bool:
    """The signs beyond ASCII are looked at only if it would matter were all of them unprintable."""
    s, wide = t.decode(), len(t.translate(None, CONTINUED))
    if len(s) - (len(t) - len(t.translate(None, CONTROLS))) - wide >= len(s) * 0.85:
        return len(s) >= 3
    bad = sum(s.count(c) for c in set(s) if unicodedata.category(c)[0] == "C" or c == "\ufffd")
    return len(s) >= 3 and len(s) - bad >= len(s) * 0.85


def _unescaped(t: bytes) -> bytes:
    """Each escape becomes its byte. Every sign of escapes has to begin one."""
    given = np.frombuffer(t + b"  ", np.uint8).copy()
    at = np.flatnonzero(given == ord("%"))
    high, low = HEX.take(given.take(at + 1)), HEX.take(given.take(at + 2))
    value = high * 16 + low
    if max(high.max(), low.max()) > 15 or value.max() == GONE:
        raise Odd
    given[at], given[at + 1], given[at + 2] = value, GONE, GONE
    return given[:-2].tobytes().translate(None, bytes([GONE]))


def _stripped(t: bytes) -> bytes:
    """Without the invisible signs; that of the perturbation first."""
    if _may_have(t, SIGN_LEADS):
        t = t.replace(ZERO_WIDTH, b"")
    return SIGNS.sub("", t.decode()).encode() if _may_have(t, SIGN_LEADS) else t


def _refuse_coded(s: str) -> None:
    bare = re.sub(f"[{WHITE}]", "", s)
    body = bare.rstrip("=")
    if len(bare) >= 20 and re.fullmatch("[A-Za-z0-9+/]+", body) and len(body) % 4 != 1:
        try:
            base64.b64decode(body + "=" * (-len(body) % 4)).decode()
        except UnicodeDecodeError:
            pass
        else:
            raise Odd
    if len(s) >= 20 and re.fullmatch("[0-9A-Fa-f]+", re.sub("0[xX]", "", bare)):
        raise Odd


def _open(t: bytes) -> bool:
    """Whether the text has a character that may be odd or change when it is composed."""
    return not t.isascii() and bool(t.translate(None, INERT))


@lru_cache(maxsize=1)
def _checked(t: bytes) -> bytes:
    if b"\b" in t or _open(t) and ODD.search(t.decode()):
        raise Odd
    return t


def _gain(t: bytes) -> int:
    """How many more markers of English the rotated text has."""
    return sum(map(GAIN.get, t.translate(WORDS).split(), repeat(0)))


def _decoded(t: bytes, gain: int | None) -> bytes:
    """One layer of escapes or of a rotation."""
    if b"%" in t and ESCAPE.search(t):
        out = _checked(_unescaped(t))
        if _plausible(out):
            return out
    if not PLAIN.search(t) and CODED.fullmatch(t.decode()):
        _refuse_coded(t.decode())
    if gain is None:
        gain = 0 if TURNS.isdisjoint(t.translate(WORDS).split()) else _gain(t)
    return t.translate(ROTATE) if gain > 0 and _plausible(t) else t


@lru_cache(maxsize=1)
def _composed(t: bytes) -> bytes:
    """Look-alikes, marks, NFKC; ASCII letters in lower case."""
    if _open(t):
        s = t.decode()
        if _may_have(t, FOLD_LEADS):
            s = s.translate(FOLD)
        if _may_have(t, MARK_LEADS):
            s = MARKS.sub("", s)
        t = unicodedata.normalize("NFKC", s).encode()
    return t.lower()


def _spaced(t: bytes) -> bytes:
    """Each run of white space as one blank."""
    t = t.translate(BLANK)
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t


def _same(a: bytes, b: bytes) -> bool:
    """Without regard to case and white space. ASCII letters are small already, and no other sign judged here becomes one of ASCII."""
    if a == b or a.translate(None, LOOSE) != b.translate(None, LOOSE):
        return a == b
    a, b = _spaced(a).strip(b" "), _spaced(b).strip(b" ")
    return a == b or a.decode().lower() == b.decode().lower()


def _spelled(spelling):
    """A change that writes each byte by its ``spelling``."""
    ways = np.frombuffer(b"".join(spelling(c).ljust(4, bytes([GONE])) for c in range(256)), np.uint32)
    return lambda t: ways[np.frombuffer(t, np.uint8)].tobytes().translate(None, bytes([GONE]))


def _one(c: int) -> bytes:
    return bytes([c])


#: P01, from UTF-8 to UTF-8, with what each makes of the gain: 1 where the words stay, -1 where they are rotated, None where
#: they are counted again. Those that come back to the text itself stand first, so that it is composed once.
CHANGES = {
    "zero_width": (_spelled(lambda c: _one(c) + (ZERO_WIDTH if chr(c) in LOWER else b"")), None),
    "url_encode": (_spelled(lambda c: _one(c) if c < 128 and (chr(c).isalnum() or chr(c) in "-._~") else b"%%%02X" % c), None),
    "double_space": (lambda t: _spaced(t).replace(b" ", b"  "), 1),
    "rot13": (lambda t: t.translate(ROTATE), -1),
    "full_width": (_spelled(lambda c: chr(c + 0xFEE0).encode() if 0x21 <= c <= 0x7E else _one(c)), None),
    "leet": (lambda t: t.translate(LEET), None),
    "case": (bytes.swapcase, 1),
    "nfkd": (lambda t: t if t.isascii() else _checked(_stripped(unicodedata.normalize("NFKD", t.decode()).encode())), None),
}


def recovered(t: bytes) -> list[str]:
    """The changes of a text that normalisation undoes, without regard to case and white space."""
    try:
        own = _checked(_stripped(t))
        gain = _gain(own)
        plain = _composed(_decoded(own, gain))

        def back(changed: bytes, times: int | None) -> bool:
            bare = _stripped(changed)
            return bare == own or _same(_composed(_decoded(bare, times and gain * times)), plain)

        return [k for k, (change, times) in CHANGES.items() if back(change(t), times)]
    except UnicodeDecodeError:
        raise Odd from None


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each change the texts of a batch and those brought back from it; texts not judged here as they are, but for bytes that
    are no UTF-8. A null is a text that nothing brings back."""
    for batch in filter(len, batches):
        n, back, odd = 0, Counter(), []
        for v in batch.column(0):
            t = v.as_py()
            try:
                back.update(() if t is None else recovered(t))
                n += 1
            except Odd:
                odd.append(t.decode(errors="replace"))
        names, none = [*CHANGES, *[None] * len(odd)], [None] * len(odd)
        columns = names, [n] * len(CHANGES) + none, [back[k] for k in CHANGES] + none, [None] * len(CHANGES) + odd
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["perturbation", "n", "recovered", "text"])
