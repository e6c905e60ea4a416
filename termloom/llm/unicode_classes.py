"""Character classes as the tokenizers library has them, whose Unicode version need not be Python's."""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Classes:
    """Insides of character classes of re, lower-case letters where they are not Python's, and the characters for which any table differs from Python's or Python has none."""

    letters: str
    numbers: str
    spaces: str
    lower: dict[str, str]
    odd: str

    def ascii(self) -> Classes:
        """The same for text that is ASCII: small classes match faster."""
        return Classes("A-Za-z", "0-9", r"\t-\r ", {}, "")

    def compile(self, pattern: str) -> re.Pattern:
        """A public pattern with \\p{L}, \\p{N}, \\s and \\S in classes or alone, with the library's members."""
        out, inside = "", False
        for token in re.findall(r"\\p\{[LN]\}|\\[sS]|\\.|.", pattern, re.DOTALL):
            members = {r"\p{L}": self.letters, r"\p{N}": self.numbers, r"\s": self.spaces, r"\S": f"^{self.spaces}"}.get(token)
            inside = token == "[" or inside and token != "]"
            out += token if members is None else members if inside else f"[{members}]"
        return re.compile(out)


def _ranges(members: list[int]) -> str:
    """Code points, ascending, as the inside of a class."""
    out, k = [], 0
    while k < len(members):
        first = last = members[k]
        while k + 1 < len(members) and members[k + 1] == last + 1:
            k += 1
            last += 1
        out.append(f"\\U{first:08x}" + (f"-\\U{last:08x}" if last > first else ""))
        k += 1
    return "".join(out)


#: Planes 4 to 13, in which no Unicode version has a character.
EMPTY_PLANES = range(0x40000, 0xE0000)


@lru_cache(1)
def library_classes() -> Classes:
    """Asks the library about every code point once (under two seconds, on the driver)."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c not in EMPTY_PLANES]
    everything = "".join(map(chr, points))

    def members(pattern: str) -> list[int]:
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(everything)
        return [points[i] for _, (begin, end) in found for i in range(begin, end)]

    letters, numbers, spaces = (members(rf"{c}+") for c in (r"\p{L}", r"\p{N}", r"\s"))

    def asked(normalizer, shape: str = "{}") -> list[str]:
        return normalizer.normalize_str("\0".join(shape.format(c) for c in everything[1:])).split("\0")

    lower = {c: x for c, x in zip(everything[1:], asked(normalizers.Lowercase()), strict=True) if x != c.lower()}
    odd = {c for c in everything[1:] if c in lower or unicodedata.category(c) == "Cn"}
    odd |= set(everything[1:]) & (set(map(chr, letters)) ^ {c for c in everything if c.isalpha()})
    for form, normalizer, shape in (("NFC", normalizers.NFC(), "{}"), ("NFD", normalizers.NFD(), "{}"), ("NFC", normalizers.NFC(), "\u0315{}\u0323")):  # compositions, their parts, and places among marks
        for c, x in zip(everything[1:], asked(normalizer, shape), strict=True):
            if x != (own := unicodedata.normalize(form, shape.format(c))):
                odd |= {c} if "\u0315" in shape else {c, *x, *own}
    odd = sorted([*map(ord, odd), *EMPTY_PLANES])
    return Classes(_ranges(letters), _ranges(numbers), _ranges(spaces), lower, _ranges(odd))
