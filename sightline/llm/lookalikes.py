"""Letters of different scripts that look alike, and characters that can't be seen."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Classes of letters with one look, by case; the first is the class's Latin letter.
CLASSES = """
aа cсϲ dԁ eе gɡ hһ iі jјϳ lӏ oоοօ pр qԛ sѕ vνѵ wԝ xх yу
AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YΥУ ZΖ
""".split()
#: Small letters that look alike in some typefaces only, Latin first; read as one where the token's other letters show its script.
SOFT = "kкκ tтτ mм".split()
#: Code points that are never seen (format characters, joiners, selectors, fillers), as hexadecimal ranges.
INVISIBLE = "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 FFF9-FFFB E0000-E0FFF"
#: Spaces of other widths than the ordinary one.
SPACES = "00A0 1680 2000-200A 202F 205F 3000"
#: Hyphens of one look.
HYPHENS = "2010 2011 2043 FE63 FF0D"
#: Blocks with full-width, half-width, joined and presentation forms.
FORMS = "0132-0133 01C4-01CC 01F1-01F3 3131-318E FB00-FDFF FE30-FFEF"


def _char_class(ranges: str) -> str:
    """The inside of a pattern's character class for hexadecimal ranges."""
    return "".join("-".join(re.escape(chr(int(end, 16))) for end in span.split("-")) for span in ranges.split())


def _points(ranges: str) -> list[str]:
    spans = [r.split("-") for r in ranges.split()]
    return [chr(c) for s in spans for c in range(int(s[0], 16), int(s[-1], 16) + 1)]


def _plain(ch: str) -> str:
    """Width, joining and presentation forms as plain letters; other characters as they are."""
    kind = unicodedata.decomposition(ch).partition(">")[0]
    joined = kind == "<compat" and unicodedata.normalize("NFKC", ch).isalpha()
    return unicodedata.normalize("NFKC", ch) if joined or kind in ("<wide", "<narrow", "<initial", "<medial", "<final", "<isolated") else ch


#: letter -> Latin letter of its look
LATIN = {c: group[0] for group in CLASSES for c in group}
#: Latin letter -> letters of that look
MEMBERS = {group[0]: group for group in CLASSES}
_SEEN = {c: _plain(c) for c in _points(FORMS)} | dict.fromkeys(_points(INVISIBLE), "") | dict.fromkeys(_points(SPACES), " ") | dict.fromkeys(_points(HYPHENS), "-")
_FOLD = {c: r for c, r in LATIN.items() if c != r}
# patterns find the few characters to change much faster than a translation table walks over all
_SEEN_PATTERN = re.compile(f"[{_char_class(' '.join((INVISIBLE, SPACES, HYPHENS, FORMS)))}]")
_FOLD_PATTERN = re.compile(f"[{''.join(_FOLD)}]")
_CYRILLIC = {ord(r): c for r, group in MEMBERS.items() for c in group if "Ѐ" <= c <= "ӿ"}
_GREEK = {ord(r): c for r, group in MEMBERS.items() for c in group if "Ͱ" <= c <= "Ͽ"}


def visible(text: str) -> str:
    """Text without characters that can't be seen, in plain widths, letters unjoined, with one kind of space and of hyphen.

    What looks different stays different: superscripts, fractions, case, accents, line breaks and added ordinary spaces.
    """
    return text if text.isascii() else _SEEN_PATTERN.sub(lambda m: _SEEN[m[0]], text)


def _folded(text: str) -> str:
    return _FOLD_PATTERN.sub(lambda m: _FOLD[m[0]], text)


def decomposed_skeleton(text: str) -> str:
    """skeleton() with accents after their letters."""
    seen = visible(text)
    return seen if seen.isascii() else _folded(unicodedata.normalize("NFD", seen))


def skeleton(text: str) -> str:
    """The text with every letter replaced by the Latin letter of its look, accents composed: equal for texts that look the same."""
    return unicodedata.normalize("NFC", decomposed_skeleton(text))


@lru_cache(maxsize=1 << 17)
def one_script(word: str) -> str:
    """A word of a skeleton in one script: that of its letters that have no Latin look-alike, else Latin; lower case."""
    if not word.isascii():
        for c in unicodedata.normalize("NFD", word):
            if "Ѐ" <= c <= "ӿ":
                return word.translate(_CYRILLIC).lower()
            if "Ͱ" <= c <= "Ͽ":
                return word.translate(_GREEK).lower()
    return word.lower()


#: A class of combining accents for patterns.
MARKS = f"[{chr(0x300)}-{chr(0x36F)}]"
_WORD = re.compile(rf"[^\W_]+(?:{MARKS}+[^\W_]*)*")


def words(text: str) -> list[str]:
    """The runs of letters and digits, compared without case and differences that can't be seen."""
    return [one_script(w) for w in _WORD.findall(skeleton(text))]


def plain_letters(text: str) -> str:
    """Lower-case letters and digits only: no accents, spaces, punctuation; look-alike and full-width letters as plain ones."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", skeleton(text))
        text = _folded(text)
    return "".join(c for c in text.lower() if c.isalnum())
