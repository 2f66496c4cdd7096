"""Words of a text in the form in which texts are compared."""

from __future__ import annotations

import re
import unicodedata

#: Zero-width characters and the soft hyphen (fixed values).
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_BROKEN = re.compile(r"(?<=[^\W_])[-‐][ \t]*\r?\n[ \t]*(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, without invisible and combining characters, broken words joined."""
    ascii_only = text.isascii()
    if not ascii_only:
        text = text.translate(INVISIBLE)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not ascii_only:
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the plain text; none for NULL."""
    return _WORD.findall(plain(text)) if text else []
