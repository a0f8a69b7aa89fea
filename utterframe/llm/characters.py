"""One form for text that looks the same: widths, spaces, invisible characters, look-alike letters.

`phonetic_form` brings a phonetic value to Latin letters, `syllabary_form` decides by word between
Cherokee and Latin letters, `search_form` is a coarse form in which look-alikes of all scripts are
one letter, for matching only.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like Latin ones (Unicode's confusables): all that
# do in Greek, Cyrillic and Armenian, and the Latin letters of other alphabets. Other scripts are not
# covered.
GREEK_CAPITALS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")
GREEK_SMALL = ("ονιρυκαγσϲϳ", "ovipukayocj")
CYRILLIC_CAPITALS = ("АВЕЅІЈКМНОРСТУХҮԌԚԜ", "ABESIJKMHOPCTYXYGQW")
CYRILLIC_SMALL = ("аеорсухѕіјһԁԛԝѵүӏ", "aeopcyxsijhdqwvyl")
ARMENIAN = ("ՍՕՏոսօհզցյգ", "UOSnuohqgjq")
OTHER_SMALL = ("ɑɡɩıո", "agiin")
# Cherokee letters that look like Latin capitals; the first of two is meant where
# a Latin letter has two.
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏞᏟᏢᏙᏚᏦᏴᏒᏔᏳ", "DRTAJEWMHGZLCPVSKBRWG")
CHEROKEE_SMALL = ("ꮃꮓꮩꮪꮯ", "wzvsc")

_VISIBLE_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD}
INVISIBLE = frozenset(c for c in range(0x30000) if unicodedata.category(chr(c)) == "Cf" and c not in _VISIBLE_FORMATS) | {
    0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x2065, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0000, 0xE1000),
}
SPACES = frozenset(c for c in range(0x3001) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")) - {0x20}
_PLAIN_KINDS = ("<wide>", "<narrow>", "<font>")
_PLAIN = {c: k.split(" ", 1)[1] for c in (*range(0x2100, 0x2150), *range(0xFF01, 0xFFE7), *range(0x1D400, 0x1D800)) if (k := unicodedata.decomposition(chr(c))).startswith(_PLAIN_KINDS)}
WIDTHS = {c: "".join(chr(int(x, 16)) for x in v.split()) for c, v in _PLAIN.items()}

#: Spaces, invisible characters and widths; the first step of every form.
BASIC = dict.fromkeys(INVISIBLE) | dict.fromkeys(SPACES, " ") | WIDTHS
_FOREIGN = {ord(a): b for group in (GREEK_CAPITALS, GREEK_SMALL, CYRILLIC_CAPITALS, CYRILLIC_SMALL, ARMENIAN, OTHER_SMALL) for a, b in zip(*group)}
_FROM_CHEROKEE = {ord(a): b for group in (CHEROKEE, CHEROKEE_SMALL) for a, b in zip(*group)}
_TO_CHEROKEE = {ord(b): a for a, b in reversed(list(zip(*CHEROKEE)))}
_LATIN_CAPITALS_ALIKE = {chr(c) for c in _TO_CHEROKEE}
_CHEROKEE_ALIKE = {chr(c) for c in _FROM_CHEROKEE}
_PHONETIC = {**BASIC, **_FOREIGN, **_FROM_CHEROKEE}

_SYLLABARY_FINE = re.compile(r"[Ꭰ-ᏽꭰ-ꮿ ,.?!:;'\"()-]*")
_WORD = re.compile(r"[^\W\d_]+")
_CHEROKEE_LETTER = re.compile(r"[Ꭰ-ᏽꭰ-ꮿ]")


# Characters beyond the basic plane stand as one range: one by one they would be tried in turn.
_NOT_PHONETIC = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(_PHONETIC) if c < 0x10000) + "\U00010000-\U0010ffff]")


def phonetic_form(value: str | None) -> str | None:
    if value is None or not _NOT_PHONETIC.search(value) and unicodedata.is_normalized("NFC", value):
        return value
    return unicodedata.normalize("NFC", value.translate(_PHONETIC)).translate(_FOREIGN)


@lru_cache(maxsize=100_000)
def _syllabary_word(word: str) -> str:
    """A word in Cherokee or in Latin letters, or a Latin stem with a Cherokee ending.

    A small Latin letter has no Cherokee look-alike here, so the part up to the last of them is
    Latin and what follows it is the ending. A word without one is Cherokee if it holds any
    Cherokee letter that looks like no other, or else any Cherokee letter at all.
    """
    word = word.translate(_FOREIGN)
    small = [i for i, c in enumerate(word) if c.islower() and not _CHEROKEE_LETTER.match(c)]
    if small:
        cut = small[-1] + 1
        return word[:cut].translate(_FROM_CHEROKEE) + word[cut:].translate(_TO_CHEROKEE)
    letters = [c for c in word if c.isalpha()]
    cherokee = [c for c in letters if _CHEROKEE_LETTER.match(c)]
    only_latin = [c for c in letters if c not in _LATIN_CAPITALS_ALIKE and not _CHEROKEE_LETTER.match(c)]
    if any(c not in _CHEROKEE_ALIKE for c in cherokee) or cherokee and not only_latin:
        return word.translate(_TO_CHEROKEE)
    return word.translate(_FROM_CHEROKEE)


def syllabary_form(value: str | None) -> str | None:
    if value is None or _SYLLABARY_FINE.fullmatch(value):
        return value
    text = unicodedata.normalize("NFC", value.translate(BASIC))
    return _WORD.sub(lambda m: _syllabary_word(m.group()), text)


_SEARCH = {**BASIC, **_FOREIGN, **_FROM_CHEROKEE}


def search_form(word: str) -> str:
    """Look-alikes of all scripts, widths and letter case as one; only for comparing.

    Full case folding, as a passage in capitals writes ß as SS and Cherokee has two cases too.
    """
    folded = unicodedata.normalize("NFC", word.translate(_SEARCH)).casefold()
    return unicodedata.normalize("NFC", folded.translate(_SEARCH)).casefold()


#: Characters that may stand within a word: combining marks, and what search_form drops.
WORD_INNER = "".join(f"\\U{c:08x}" for c in sorted(INVISIBLE) if c < 0xE0000) + r"̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯\U000e0000-\U000e0fff"
#: A run of letters, digits and combining marks ('_' must be blanked before).
WORD = re.compile(rf"[\w{WORD_INNER}]+")
