from pyspark.sql import functions as F

from utterframe.functions import text as X
from utterframe.functions.text import intrusion_mask, syncope_mask
from utterframe.functions.tones import canonical_toned, enriched_syllable, mora_letters, mora_streams, mora_tokens, numbered_tones, reconciled, resolve_hiatus, syllabary_writing, to_syllabary, tone_contour, without_asterisks


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_cleaning(spark):
    assert one(spark, X.normalize_text, "  It’s “Fine”,  OK?! ", "", None) == ["it's fine ok", "", None]
    assert one(spark, X.ascii_form, "Gaʔdu-9 É", None) == ["ga'du", None]
    assert one(spark, X.clean_transcription, "a*b|c\t d") == ["a b c d"]
    assert one(spark, X.boundary_stripped, "«ab-c!»", "...") == ["ab-c", ""]


def test_speakers(spark):
    assert one(spark, X.speaker_of, "Ann: hello: you", "no colon", ": x", "Ann:", "x" * 41 + ": y", None) == ["Ann", None, None, None, None, None]
    assert one(spark, X.body_of, "Ann: hello: you", "no colon") == ["hello: you", "no colon"]


def test_orthographies(spark):
    assert one(spark, X.syllabary_to_phonetics, "ᎢᎾᎨᎢ", "ᏣᎳᎩ", "ᎠᏍ", "ᏒᏃ, x") == ["inake'i", "tsalaki", "ahs", "svno, X"]
    assert one(spark, X.base_transliteration, "ᎠᏍᎩ") == ["aski"]
    assert one(spark, X.standardize_glottals, "a’’b", "k'a", "'ka a'") == ["a'b", "ka", "ka a'"]
    assert one(spark, X.collapse_double_vowels, "aabbee") == ["abbe"]
    assert one(spark, X.strip_tones, "a2:3é") == ["ae"]
    assert one(spark, X.respell_consonants, "tsa", "ta", "dga", "hna", "asa", "sa", "ja") == ["tsa", "tha", "tka", "nha", "ahsa", "sa", "tsa"]
    assert one(spark, X.dg_to_tth, "Gawonihi-sdi", "quu") == ["kawonihihsti", "kwu"]


def test_phonemes(spark):
    got = one(spark, X.phonemes, "hska'", "tsh a", "", None)
    assert [(p.symbol, p.category, p.start, p.end) for p in got[0]] == [("hsk", "sibilant_cluster", 0, 3), ("a", "vowel", 3, 4), ("'", "glottal_stop", 4, 5)]
    assert [p.symbol for p in got[1]] == ["tsh", " ", "a"] and got[2] == [] and got[3] is None
    assert one(spark, X.valid_phonotactics, "kanu", "ahha", "k'a", "thlha", "tlha", "", None) == [True, False, False, False, True, True, None]


def bits(mask):
    return "".join("01"[m] for m in mask)


def test_masks():
    assert bits(syncope_mask("kanu")) == "0101" and bits(syncope_mask("a ka")) == "0001"
    assert bits(syncope_mask("tanha")) == "00001" and bits(syncope_mask("tla")) == "101"
    assert bits(intrusion_mask("kanu")) == "0111" and bits(intrusion_mask("athsa", letters=False)) == "1100"
    assert bits(intrusion_mask("a'ka")) == "1001" and syncope_mask("") == intrusion_mask("") == []


def test_tones(spark):
    assert numbered_tones("gádò") == "ga3do21" and numbered_tones("na:") == "na22" and numbered_tones("") == ""
    assert mora_streams("na3 a2ni22tshu34tsa2") == ("na anitshutsa", "C 3_1 | 2_1 C 2_1 2_2 C 3_1 4_2 C 2_1")
    assert [tuple(p) for p in one(spark, tone_contour, "C 3_1 | 2_1 2_2")[0]] == [(1, 3), (3, 2), (4, 2)]
    toned = "na3 a2ni22tshu34tsa2"
    assert one(spark, mora_letters, toned, None) == [mora_streams(toned)[0], None] and one(spark, mora_tokens, toned, None) == [mora_streams(toned)[1], None]
    assert resolve_hiatus("inakei") == "inake'i" and resolve_hiatus("aa a:a") == "aa a:'a"


def test_canonical_tones(spark):
    got = one(spark, canonical_toned, "na3 a2ni22tshu34tsa2", "ná à:nìdzú", "deh:yv", "ga:́̂", "a::", "so;sda; x’", "", None)
    assert got[:3] == ["na3 a2ni22tshu34tsa2", "na3 a21ni21tzu3", "te2yhv2"]
    assert got[4] is None and got[6:] == ["", None] and got[5] == "so22hsta2 x"
    assert one(spark, without_asterisks, "ì*:sgv", "pre*stem*suf", "*word*next", "none") == ["ì:sgv", "pre stem suf", "word next", "none"]


def test_writing(spark):
    samples = ["tsalaki", "galohsga x", "thv hsi", "", "hlhsq 'a", "sdanh", "losh hsh", "skhwa hsqx"]
    assert one(spark, syllabary_writing, *samples, None) == [*map(to_syllabary, samples), None]
    assert to_syllabary("tsalaki") == "ᏣᎳᎩ" and to_syllabary("galohsga x") == "ᎦᎶᏍᎦ x"
    assert to_syllabary("thv hsi") == "Ꮫ Ꮟ" and to_syllabary("") == ""


def test_enrichment():
    assert enriched_syllable("la", "lha") == "lha" and enriched_syllable("na", "n") == "n" and enriched_syllable("ka", "ka'") == "ka'"
    assert enriched_syllable("si", "hsi") == "hsi" and enriched_syllable("a", "ah") == "ah" and enriched_syllable("ta", "tah") == "tah"
    assert enriched_syllable("ka", "'ka") == "'ka" and enriched_syllable("a", "'a") == "a"
    assert reconciled([("Ꮳ", "tsa"), ("Ꮃ", "lha"), (" ", " "), ("Ꭹ", "")]) == "tsalha k" and reconciled([]) == ""


def test_tokens(spark):
    assert one(spark, X.token_class, "ᎠᎡ", "AnnᏂ", "don't", "...") == ["cherokee_syllabary", "compound_clitic", "english", "punctuation"]
    assert [tuple(r) for r in one(spark, X.clitic_parts, "AnnᏂ", "Ann")] == [("Ann", "Ꮒ"), ("", "")]
    assert [[tuple(x) for x in r] for r in one(spark, X.spelling_violations, "das hs", "s")] == [[(1, "d"), (3, "s")], []]
