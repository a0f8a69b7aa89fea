"""Text functions as Column expressions: cleaning, orthographies, phonemes, tokens, speakers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The syllables of the Cherokee block from U+13A0 on, in its order.
SYLLABLES = (
    "a e i o u v ka kha ke ki ko ku kv ha he hi ho hu hv la le li lo lu lv ma me mi mo mu na nha nah ne ni no nu nv "
    "kwa kwe kwi kwo kwu kwv sa s se si so su sv ta tha te the ti thi to tu tv tla tla tle tli tlo tlu tlv "
    "tsa tse tsi tso tsu tsv wa we wi wo wu wv ya ye yi yo yu yv"
).split()
FIRST = 0x13A0
VOWELS = "aeiouv"
GLOTTALS = "'’ʼʔ‘ʻ`‚?"
# Phoneme symbols by category.
PHONEMES = {
    "sibilant_cluster": ("hskw", "hsts", "hsk", "hst", "hsl", "slh"),
    "aspirated_stop": ("kwh", "tlh", "tsh", "ch", "th", "kh"),
    "plain_stop": ("kw", "gw", "qu", "ts", "tl", "t", "d", "k", "g", "j"),
    "sibilant": ("hs", "s"),
    "voiceless_sonorant": ("lh", "nh", "wh", "yh"),
    "plain_sonorant": ("l", "m", "n", "w", "y"),
    "laryngeal_fricative": ("h",),
    "glottal_stop": ("'",),
    "vowel": tuple(VOWELS),
}
_CATEGORY = {symbol: name for name, symbols in PHONEMES.items() for symbol in symbols}
#: Longest symbols first, any other character by itself.
PHONEME_PATTERN = "|".join(sorted(_CATEGORY, key=lambda s: (-len(s), s))) + "|[\\s\\S]"
_SYLLABLE_OF = {chr(FIRST + i): s for i, s in enumerate(SYLLABLES)}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ascii_form(text: Column) -> Column:
    """Lower-case letters, apostrophes and single spaces only; glottal signs become apostrophes."""
    unified = F.translate(F.lower(text), GLOTTALS, "'" * len(GLOTTALS))
    return squeeze(F.regexp_replace(unified, "[^a-z' ]", ""))


# The signs of the two cleaning rules.
_APOSTROPHES = re.compile("[’‘ʼʻ`´‛]")
_REMOVED = re.compile(r"[,?.!\-;:\"“%”\\()\[\]{}«»…]")
_SPACED = re.compile(r"[\[\]\"().\u0f7b_|》?!/,\-<…>*]")


def _normalized(text: str) -> str:
    low = _APOSTROPHES.sub("'", unicodedata.normalize("NFC", text).lower())
    return re.sub(r"\s+", " ", _REMOVED.sub("", low)).strip()


def _cleaned(text: str) -> str:
    return " ".join(_SPACED.sub(" ", text).split()).lower()


def _by_text(rule: Callable[[str], str], text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rule(t) for t in texts], dtype=object)

    return run(text)


def normalize_text(text: Column) -> Column:
    """NFC, lower case, one apostrophe, no punctuation, single spaces; Spark has no NFC of its own."""
    return _by_text(_normalized, text)


def clean_transcription(text: Column) -> Column:
    """Marks of transcription and punctuation become spaces; single spaces, lower case."""
    return _by_text(_cleaned, text)


def boundary_stripped(token: Column) -> Column:
    """A token without punctuation at its ends."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def speaker_of(line: Column, longest: int = 40) -> Column:
    """The name before the first colon, if it is short and something follows."""
    name, body = F.trim(F.substring_index(line, ":", 1)), F.trim(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1))
    return F.when(line.contains(":") & (F.length(name) > 0) & (F.length(name) <= longest) & (F.length(body) > 0), name)


def body_of(line: Column) -> Column:
    return F.when(speaker_of(line).isNotNull(), F.trim(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1))).otherwise(line)


def is_syllabary(text: Column) -> Column:
    return text.rlike("[Ꭰ-ᏽꭰ-ꮿ]")


def base_transliteration(text: Column) -> Column:
    """Syllable by syllable, without any rule of context; other characters stay as they are."""
    letters = F.transform(F.split(F.upper(text), ""), lambda c: F.coalesce(F.element_at(_map(_SYLLABLE_OF), c), c))
    return F.array_join(letters, "")


def syllabary_to_phonetics(text: Column, contextual: bool = True) -> Column:
    """Transliteration with pre-aspirated sibilants and a glottal stop between vowels.

    contextual: `s` takes its `h` only after a vowel or sonorant within a word, else always.
    """
    plain = base_transliteration(text)
    aspirated = F.regexp_replace(plain, r"(?U)([^ht\s])s", "$1hs") if contextual else F.regexp_replace(plain, "(?<![t])s", "hs")
    return F.regexp_replace(aspirated, r"([aeiouvAEIOUV])(?=[aeiouvAEIOUV])", "$1'")


# One apostrophe for every glottal sign, none after a consonant or before a word's first
# one. v, though a vowel, counts as a consonant here as in the rule that this must equal.
_C = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]"
GLOTTAL_RULES = [(f"[{GLOTTALS}]+", "'"), (f"(?<={_C})'+", ""), (f"(?<!\\S)'+(?={_C})", "")]
# S takes an h before it within a word, and none at a word's beginning.
SIBILANT_RULES = [(r"([^ht\s])s", "$1hs"), (r"(?<!\S)hs", "s")]
# d/g spelling to t/th spelling; the order of the steps is part of the rule.
RESPELLING = [
    *GLOTTAL_RULES, ("t(?![sh])", "th"), ("d", "t"), ("k(?!h)", "kh"), ("g", "k"), ("j", "ts"), ("ch", "tsh"), ("hn", "nh"), ("hl", "lh"),
    ("hy", "yh"), ("hw", "wh"), ("sl(?=[aeiouvAEIOUV])", "slh"), *SIBILANT_RULES, *GLOTTAL_RULES,
]


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def standardize_glottals(text: Column) -> Column:
    """One apostrophe for every glottal sign; none after a consonant or before a word's first one."""
    return _rewritten(text, GLOTTAL_RULES)


def strip_tones(text: Column) -> Column:
    """Without length colons, tone digits and combining marks."""
    return F.regexp_replace(text, "[:ː0-9̀-ͯ]", "")


def collapse_double_vowels(text: Column) -> Column:
    return F.regexp_replace(text, r"([aeiouvAEIOUV])\1+", "$1")


def respell_consonants(text: Column) -> Column:
    """d/g spelling to t/th spelling."""
    return _rewritten(text, RESPELLING)


def dg_to_tth(text: Column) -> Column:
    low = F.replace(F.replace(F.lower(F.replace(strip_tones(text), F.lit("-"), F.lit(""))), F.lit("qu"), F.lit("gw")), F.lit("tl"), F.lit("dl"))
    return normalize_text(standardize_glottals(respell_consonants(low)))


_PHONEME = re.compile(PHONEME_PATTERN, re.IGNORECASE)
_SPANS = T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()), T.StructField("category", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _spans(text: str) -> list[tuple[str, str, int, int]]:
    return [(m.group(), _CATEGORY.get(m.group().lower(), "other"), m.start(), m.end()) for m in _PHONEME.finditer(text)]


def phonemes(text: Column) -> Column:
    """array<struct<symbol, category, start, end>> by longest match.

    Offsets need the symbols before them, which nested array functions would find again for each.
    """

    @F.pandas_udf(_SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(("symbol", "category", "start", "end"), x)) for x in _spans(t)] for t in texts], dtype=object)

    return run(text)


#: Each phoneme as one letter, so that rules over neighbours are patterns: V vowel, P and A plain and
#: aspirated stop (l and L if lateral), S sibilant (Z with its breath), R and O sounding and voiceless
#: sonorant, K and k cluster (k with a breath at its end), H breath, Q glottal stop, X anything else.
_LETTER = {"vowel": "V", "plain_stop": "P", "aspirated_stop": "A", "sibilant": "S", "plain_sonorant": "R", "voiceless_sonorant": "O", "sibilant_cluster": "K", "laryngeal_fricative": "H", "glottal_stop": "Q", "other": "X"}
_SPECIAL = {"tl": "l", "tlh": "L", "hs": "Z", "slh": "k"}
#: Two laryngeals together, a glottal stop after a consonant, a voiceless sonorant after a stop.
_FORBIDDEN = re.compile("[ALOkHQ][ZKHQ]|[PAlLSZROKk]Q|[PAlL]O")
#: What fast speech may drop: a vowel after a consonant, unless a stop and a voiceless sonorant would
#: meet; and the stop of a lateral affricate.
_DROPPABLE = re.compile("(?<=[SZROKk])V|(?<=[PAlL])V(?!O)|[lL]")
#: Where speech may put a breath or a glottal stop: before a consonant that follows no laryngeal or
#: cluster, before a plain consonant's vowel, and before a vowel that comes first.
_OPEN = re.compile("(?<=[VPlSRX])[PAlLSRO]|(?<=[PlR])V|^V")


def _classes(spans: list[tuple]) -> str:
    return "".join(_SPECIAL.get(symbol.lower()) or _LETTER[category] for symbol, category, _, _ in spans)


def _mask(pattern: re.Pattern, text: str, letters: bool, first_only: str = "") -> list[bool]:
    """Where a pattern finds single phonemes, by phoneme or by letter; of classes in `first_only` only
    the first letter counts."""
    spans = _spans(text)
    classes = _classes(spans)
    found = {m.start() for m in pattern.finditer(classes)}
    if not letters:
        return [i in found for i in range(len(spans))]
    return [i in found and (k == 0 or classes[i] not in first_only) for i, (_, _, a, b) in enumerate(spans) for k in range(b - a)]


def syncope_mask(text: str, letters: bool = True) -> list[bool]:
    return _mask(_DROPPABLE, text, letters, "lL")


def intrusion_mask(text: str, letters: bool = True) -> list[bool]:
    return _mask(_OPEN, text, letters)


def valid_phonotactics(text: Column) -> Column:
    """Whether no forbidden neighbours stand in a text."""

    @F.pandas_udf(T.BooleanType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else not _FORBIDDEN.search(_classes(_spans(t))) for t in texts], dtype=object)

    return run(text)


def token_class(token: Column) -> Column:
    """Type of a code-switched token by its letters."""
    cherokee, latin = is_syllabary(token), token.rlike("[A-Za-z]")
    return F.when(cherokee & latin, "compound_clitic").when(cherokee, "cherokee_syllabary").when(latin, "english").otherwise("punctuation")


def clitic_parts(token: Column) -> Column:
    """struct<stem, clitic> of a Latin stem with a Cherokee ending."""
    return F.struct(F.regexp_extract(token, "^([A-Za-z']+)[Ꭰ-ᏽꭰ-ꮿ]+$", 1).alias("stem"), F.regexp_extract(token, "^[A-Za-z']+([Ꭰ-ᏽꭰ-ꮿ]+)$", 1).alias("clitic"))


def spelling_violations(text: Column) -> Column:
    """array<struct<position, letter>>: d, g or c, and s without h, t or a space before it."""
    letters = F.split(text, "")
    marked = F.transform(letters, lambda c, i: F.struct((i + 1).alias("position"), c.alias("letter"), F.get(letters, i - 1).alias("before")))
    wrong = F.filter(marked, lambda x: x.letter.isin("d", "g", "c") | (x.letter == "s") & ~F.coalesce(x.before, F.lit(" ")).isin("h", "t", " "))
    return F.transform(wrong, lambda x: F.struct(x.position, x.letter))
