"""Every operator on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import random


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from utterframe.llm import canonical, chunks, languages, leaks, mixture, overlaps, packing, subjects
from utterframe.llm.characters import phonetic_form, search_form, syllabary_form


# -- splitting ---------------------------------------------------------------
PAUSES = "array<struct<start_ms:bigint,end_ms:bigint>>"
ITEMS = f"item_id string, start_ms bigint, end_ms bigint, limit_ms bigint, overlap_ms bigint, boundaries {PAUSES}, piece_no int"


def test_pieces_cover_overlap_and_stay_within_the_limit(spark):
    rng, rows = random.Random(1), []
    for i in range(60):
        n = rng.randrange(0, 40)
        pauses = [(a := rng.randrange(0, 90_000), a + rng.randrange(-50, 300)) for _ in range(n)]
        rows.append((str(i), 0, 95_001, 10_000, rng.choice([0, 250, None]), rng.choice([pauses, pauses, None]), 9))
    rows += [("short", 0, 10_000, 10_000, 0, [], 0), ("null", None, 5, 10, 0, [], 0), ("back", 9, 5, 10, 0, [], 0)]
    out = chunks.split_items(spark.createDataFrame(rows, ITEMS)).toPandas()
    given = {r[0]: r for r in rows}
    assert set(out.item_id) == {r[0] for r in rows} - {"null", "back"}
    for key, p in out.sort_values("piece_no").groupby("item_id"):
        _, start, end, limit, overlap, pauses, _ = given[key]
        a, b = p.piece_start_ms.tolist(), p.piece_end_ms.tolist()
        assert a[0] == start and b[-1] == end and (p.piece_end_ms - p.piece_start_ms).max() <= limit
        assert all(x == y - (overlap or 0) for x, y in zip(a[1:], b[:-1]))
        mids = {(s + e) // 2 for s, e in pauses or [] if e > s}
        assert all((e in mids) == (k == "pause") for e, k in zip(b[:-1], p.cut_kind[:-1]))


def test_an_edit_alters_only_neighbouring_pieces():
    """1,000 edits that move, drop or add a pause: few cuts change, however long the item."""
    rng, changed = np.random.default_rng(3), []
    for trial in range(1000):
        n, k = 300, int(rng.integers(1, 299))
        at, length = np.cumsum(rng.integers(800, 2500, n)), rng.integers(20, 300, n)
        end, by = int(at[-1]) + 500, 777 if trial % 3 == 0 else 0
        before, _ = chunks.cut(0, end, at, length, 20_000, 500)
        moved, size = [(np.r_[at[:k], at[k:] + by], length), (np.delete(at, k), np.delete(length, k)), (np.insert(at, k, (at[k - 1] + at[k]) // 2), np.insert(length, k, 99))][trial % 3]
        after, _ = chunks.cut(0, end + by, moved, size, 20_000, 500)
        changed.append(len(set(after) - {c + by if c >= at[k] else c for c in before}))
    assert max(changed) <= 5 and np.mean(np.array(changed) > 3) < 0.01 and np.mean(changed) < 1


def test_forced_cuts_only_where_no_boundary_is_in_reach():
    rng = np.random.default_rng(4)
    for _ in range(300):
        at = np.unique(rng.integers(1, 99_999, int(rng.integers(0, 40))))
        cuts, forced = chunks.cut(0, 100_000, at, np.full(len(at), 50), 10_000, 500)
        assert any(forced) == (np.diff(np.r_[0, at, 100_000]).max() > 9_500)
        assert np.diff([0, *cuts, 100_000]).max() <= 9_500


# -- mixing ------------------------------------------------------------------
def test_sources_fill_their_share(spark):
    rows = [("d", f"/raw/Big_Src/{i}.wav", f"a/{i}.wav", f"{i:064x}", 2.0, "x") for i in range(500)]
    rows += [("d", f"C:\\x\\RAW\\small-src\\{i}.wav", f"b/{i}.wav", None, 3.0, "x") for i in range(10)]
    rows += rows[:30] + [("d", "./raw//./big%20src/z.wav", "a/z.wav", f"{3:064X}", 2.0, "x"), ("d", "raw/big src/n.wav", "a/n.wav", None, None, "x"), ("d", None, None, None, -1.0, "x")]
    files = mixture.files_of(spark.createDataFrame(rows, "dataset_name string, source_path string, target_rel_path string, sha256 string, duration_sec double, uses string"))
    targets = mixture.targets_of(spark.createDataFrame([("d", "big src", 0.5, 3, 2468.0), ("d", "Small Src", 0.5, 4, 2468.0), ("d", "none", 0.1, 4, 2468.0), ("d", "big src", None, None, None)], "dataset_name string, source_name string, target_share double, max_repeats int, budget_sec double"))
    uses = mixture.plan_uses(files, targets)
    got = {(r.source_name, r.max_repeats): r for r in mixture.shares(files, targets, uses).collect()}
    assert len(got) == 4
    small = got["Small Src", 4]
    assert small.size_ms == 30_000 and small.filled_ms == 120_000 and small.most_uses == 4 and small.too_small
    assert got["none", 4].size_ms == 0 and got["none", 4].too_small


def test_weights_come_first_and_ranges_stay_even(spark):
    rows = [("d", f"raw/s/{i}.wav", f"{i}", None, 1.0) for i in range(4000)]
    files = mixture.files_of(spark.createDataFrame(rows, "dataset_name string, source_path string, target_rel_path string, sha256 string, duration_sec double"))
    files = files.withColumn("w", F.when(F.col("file").endswith("0"), 1e6).otherwise(1.0))
    targets = mixture.targets_of(spark.createDataFrame([("d", "s", 1.0, 1, 400.0)], "dataset_name string, source_name string, target_share double, max_repeats int, budget_sec double"))
    used = mixture.plan_uses(files, targets, F.col("w")).where("uses > 0").toPandas()
    assert len(used) == 400 and used.file.str.endswith("0").mean() > 0.99
    equal = mixture.plan_uses(files, targets).where("uses > 0").toPandas()
    assert len(equal) == 400 and equal.file.str.endswith("0").mean() < 0.3


def test_complete_epochs_precede_a_fraction(spark):
    rows = [("d", f"raw/s/{i}.wav", f"{i}", None, 1.0 + i % 3) for i in range(300)]
    files = mixture.files_of(spark.createDataFrame(rows, "dataset_name string, source_path string, target_rel_path string, sha256 string, duration_sec double"))
    targets = mixture.targets_of(spark.createDataFrame([("d", "s", 1.0, 5, 1501.0)], "dataset_name string, source_name string, target_share double, max_repeats int, budget_sec double"))
    uses = mixture.plan_uses(files, targets).toPandas()
    assert set(uses.uses) == {2, 3} and len(uses) == 300
    assert abs((uses.uses * uses.duration_ms).sum() - 1_501_000) <= 1_500
    again = mixture.plan_uses(files.repartition(7), targets).toPandas()
    assert sorted(map(tuple, uses.values.tolist())) == sorted(map(tuple, again.values.tolist()))


# -- characters --------------------------------------------------------------
@pytest.mark.parametrize("shown, right", [("ᏗᏝ\u200bᏗ", "ᏗᏝᏗ"), ("DᏛᏦ", "ᎠᏛᏦ"), ("ΑᏒᎼ", "ᎪᏒᎼ"), ("KembyᎢ", "KembyᎢ"), ("ＫembyᏃᎯ？", "KembyᏃᎯ?"), ("Ꮶemby", "Kemby"), ("a\u00a0b\u3000c", "a b c"), ("", ""), ("ᎦᎾ, Well.", "ᎦᎾ, Well.")])
def test_syllabary_form(shown, right):
    assert syllabary_form(shown) == right and syllabary_form(right) == right


def test_phonetic_form():
    assert phonetic_form("gаdu\u00adʔ") == "gaduʔ" and phonetic_form("v\u0323\u0300") == "ṿ\u0300" and phonetic_form("ｇａ") == "ga"
    assert phonetic_form("v\u0301") == "v\u0301" and phonetic_form(None) is None
    assert search_form("Ｈeаrt") == search_form("HEART")


def test_values_under_one_collation_class_take_one_form(spark):
    values = ["gá\u0001du", "gádu", "ga\u0301du", "gàdu", "Gádu", "", None]
    df = spark.createDataFrame([("phonetic", v, "z") for v in values] * 2, "kind string, value string, form string")
    got = {r.value: r.form for r in canonical.forms(df).collect()}
    assert got["ga\u0301du"] == got["gádu"] == got["gá\u0001du"] == "gádu"
    assert got["gàdu"] == "gàdu" and got["Gádu"] == "Gádu" and got[""] == "" and None not in got
    assert canonical.forms(df.limit(0)).count() == 0


# -- overlaps ----------------------------------------------------------------
def test_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x13A0, 0x13F0)]
    words = ["".join(rng.choices(letters, k=rng.randrange(2, 5))) for _ in range(150)]
    rows, texts = [], []
    for i in range(160):
        t = " ".join(rng.choices(words, k=rng.randrange(3, 12)))
        if texts and rng.random() < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(letters)
            t = "".join(t)
        texts.append(t)
        s, g = rng.choice([(t, t.lower()), (None, "x" + t), (t, None)])
        rows.append((f"i{i}", rng.choice(["train", " Training", "test", "DEV", None]), s, g, "src", 1))
    rows += rows[:10] + [("n", "train", None, None, "src", 1), ("e", "test", "", "", None, 1)]
    df = spark.createDataFrame(rows, "sample_id string, split string, syllabary_raw string, gt_target string, source string, key int")
    p = overlaps.prepared(df).toPandas().drop_duplicates()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diag, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        return row[-1]

    want = set()
    for a in p[p.side == "e"].itertuples():
        for b in p[p.side == "t"].itertuples():
            u, v = (a.s, b.s) if a.s and b.s else (a.g, b.g)
            if u and v and min(len(u.split()), len(v.split())) >= 4 and abs(len(u) - len(v)) <= 0.15 * max(len(u), len(v)) and distance(u, v) <= 0.15 * max(len(u), len(v)):
                want.add((a.sample_id, b.sample_id))
    rows = overlaps.prepared(df)
    got = {(r.e_id, r.t_id) for r in overlaps.overlapping(rows).collect()}
    assert want and got <= want and len(want - got) <= 0.02 * len(want)
    assert overlaps.overlapping(overlaps.prepared(df.limit(0))).count() == 0
    listed = pd.Series([e for e, _ in got]).value_counts().to_dict()
    assert {r.e_id: r.n for r in overlaps.overlap_counts(rows).collect()} == listed


def test_counts_of_samples_with_several_versions(spark):
    """Pairs are counted once, whatever the versions of a sample and however many copies there are."""
    a, b = "aa bb cc dd ee", "aa bb cc dd ff gg hh ii"
    rows = [(f"t{i}", "train", a, a) for i in range(5)] + [("t0", "train", b, a), ("t9", "train", None, a), ("x", "train", a, None)]
    rows += [("e0", "test", a, None), ("e1", "dev", a, b), ("e1", "dev", b, b), ("e2", "test", None, a), ("x", "test", a, None)]
    df = spark.createDataFrame([(*r, "src") for r in rows], "sample_id string, split string, syllabary_raw string, gt_target string, source string")
    prepared = overlaps.prepared(df)
    pairs = {(r.e_id, r.t_id) for r in overlaps.overlapping(prepared).collect()}
    counts = {r.e_id: (r.n, r.same) for r in overlaps.overlap_counts(prepared).collect()}
    assert {k: n for k, (n, _) in counts.items()} == pd.Series([e for e, _ in pairs]).value_counts().to_dict()
    assert counts["e0"] == (6, 6) and ("x", "x") not in pairs and counts["e2"] == (6, 6)


@pytest.mark.parametrize("field", ["s", "g"])
def test_recall_at_the_largest_allowed_distance(spark, field):
    """Pairs with as many random edits as are allowed, in the letters of each field."""
    rng = random.Random(8)
    letters, size = ([chr(c) for c in range(0x13A0, 0x13F0)], (2, 5)) if field == "s" else (list("aeiouvhklmnstwy"), (4, 10))
    rows = []
    for i in range(400):
        t = " ".join("".join(rng.choices(letters, k=rng.randrange(*size))) for _ in range(rng.randrange(5, 11)))
        near = list(t)
        for at in rng.sample([k for k, c in enumerate(t) if c != " "], int(0.15 * len(t))):
            near[at] = rng.choice([c for c in letters if c != t[at]])
        rows += [(f"e{i}", "test", t), (f"t{i}", "train", "".join(near))]
    one, other = ("syllabary_raw", "gt_target") if field == "s" else ("gt_target", "syllabary_raw")
    df = spark.createDataFrame([(*r, None, "src") for r in rows], f"sample_id string, split string, {one} string, {other} string, source string")
    found = overlaps.overlapping(overlaps.prepared(df)).where("substring(e_id, 2) = substring(t_id, 2)").count()
    assert found >= 0.95 * 400


# -- leaks -------------------------------------------------------------------
TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_leaks(spark):
    docs = [(1, f"Start. {TEXT.upper().replace(' ', '  -')}!"), (2, TEXT.replace("five", "fife")), (3, "оne  twо\nthree four, five_six seven\u200b eight nine ten"), (4, None), (5, ""), (6, " ".join(TEXT.split()[:9])), (None, TEXT), (1, f"Start. {TEXT.upper().replace(' ', '  -')}!")]
    items = [(7, TEXT), (8, TEXT), (9, "too short"), (10, None), (7, TEXT)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    want = {(1, 7), (1, 8), (3, 7), (3, 8)}
    assert sorted(map(tuple, leaks.leaked_items(d, i).collect())) == sorted(want)
    assert {tuple(r) for r in leaks.leaked_items(d, i, max_grams=12).collect()} == want
    clean = {r.doc_id: r for r in leaks.without_leaks(d, i).collect()}
    assert clean[1].n_words_removed == 12 and clean[1].text == "Start. !" and clean[2].n_words_removed == 0
    # A limit that puts each item into a block of its own changes nothing.
    assert {r.doc_id: r for r in leaks.without_leaks(d, i, max_grams=12).collect()} == clean
    assert leaks.leaked_items(d, i.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), i).count() == 0


def test_leaks_whatever_the_case(spark):
    text = "die straße war groß und der fuß maß nur ein stück weiß"
    docs = spark.createDataFrame([(1, text.upper()), (2, "ꭰꭱ ꭲꭳ ꭴꭵ ꭶꭷ ꭸꭹ ꭺꭻ ꭼꭽ ꭾꭿ ꮀꮁ ꮂꮃ")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text), (2, "ᎠᎡ ᎢᎣ ᎤᎥ ᎦᎧ ᎨᎩ ᎪᎫ ᎬᎭ ᎮᎯ ᎰᎱ ᎲᎳ")], "item_id bigint, text string")
    assert sorted(map(tuple, leaks.leaked_items(docs, items).collect())) == [(1, 1), (2, 2)]


def test_spans_that_overlap_are_cut_once():
    words = TEXT.split()
    assert leaks.cut_spans(TEXT, [0, 2], 10, "#") == ("#", 12)
    assert leaks.cut_spans("x " + TEXT + " y z", [1], 10, "") == ("x  eleven twelve y z", 10)
    assert leaks.cut_spans(" ".join(words * 2), [0, 12], 10, "#") == ("# eleven twelve # eleven twelve", 20)


# -- packing -----------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([3, 7, 20, 33, 64, 250]) for _ in range(400)] + [100] * 50 + [0, None]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)] * 2, "doc_id bigint, n_tokens bigint, size int")
    out = packing.pack(df, [100, 64, None, 0]).toPandas()
    for capacity, p in out.groupby("capacity"):
        fill = p.groupby("container_id").n_tokens.sum()
        total = p.groupby("doc_id").n_tokens.sum()
        bins = []
        for n in sorted((n if n <= capacity else n % capacity for n in sizes if n), reverse=True):
            at = min((i for i, b in enumerate(bins) if b >= n), key=lambda i: bins[i], default=None)
            if n and at is None:
                bins.append(capacity - n)
            elif n:
                bins[at] -= n
        assert fill.max() <= capacity and p.container_id.str.startswith("shared").groupby(p.container_id).first().sum() <= 1.02 * len(bins) + 1
        assert total.to_dict() == {i: n for i, n in enumerate(sizes) if n}
        pieces = p.groupby("doc_id").size()
        assert all(pieces[i] == -(-n // capacity) for i, n in enumerate(sizes) if n)
    assert packing.pack(df.limit(0), [10]).count() == 0 and packing.pack(df, []).count() == 0


# -- languages and subjects ----------------------------------------------------
EN = ["the man and the woman were not in the house", "we did not know that they had been there", "is it true that the bridge was closed"]
ES = ["el hombre y la mujer no estaban en la casa", "no sabíamos que habían estado allí", "es verdad que el puente estaba cerrado"]


def language_docs():
    rng = random.Random(4)
    return [(i, " ".join(rng.choices(EN if i % 2 else ES, k=6)) + ".", "English" if i % 2 else "es-MX", "x") for i in range(200)]


def test_languages(spark):
    docs = language_docs()
    docs += [(900, f"{EN[0]}. {EN[1]}.\n \t\n{ES[0]} ({EN[2]}). {ES[1]}; {ES[2]}.\r\n\r\n...", "en", "x"), (901, None, "en", "x"), (902, "", None, "x"), (None, EN[0], "en", "x"), (903, f"\n\n{ES[0]}", None, "x")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string, lang string, label string")
    got = {(r.doc_id, r.unit_no): r for r in languages.paragraph_languages(df).collect()}
    assert [got[900, i].lang for i in range(3)] == ["en", "es", "und"] and got[900, 2].confidence == 0
    assert got[903, 0].lang == "es" and got[903, 0].label is None
    assert all(got[i, 0].lang == ("en" if i % 2 else "es") for i in range(200)) and not {901, 902, None} & {k[0] for k in got}
    assert languages.paragraph_languages(df.limit(0)).count() == 0
    assert languages.paragraph_languages(df.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_labels(spark):
    names = ["en", "EN-us", " English ", "eng", "en_GB", "chr_Cher", "Cherokee", "fra", "German", "und", "", None, "entish", "pt"]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    assert [r[0] for r in df.select(languages.label_language(F.col("lang"))).collect()] == ["en"] * 5 + ["chr"] * 2 + ["fr", "de"] + [None] * 5


def test_tokens(spark):
    token = "array<struct<raw_token:string,token_type:string>>"
    rows = [(1, "x", [("ᎠᎡ", "Cherokee_Syllabary"), ("don't", "none"), ("KembyᏂ", None), ("...", "english"), (None, "x")]), (2, "ᎠᎡ  well ?", []), (3, None, None), (2, "ᎠᎡ  well ?", [])]
    got = {(r.line_id, r.unit_no, r.right) for r in languages.wrong_tokens(spark.createDataFrame(rows, f"line_id bigint, raw_text string, tokens {token}")).collect()}
    assert got == {(1, 1, "english"), (1, 2, "compound_clitic"), (1, 3, "punctuation"), (2, 0, "cherokee_syllabary"), (2, 1, "english"), (2, 2, "punctuation")}


def test_subjects(spark):
    rng = random.Random(6)
    terms = {"sport": ["team", "referee", "goal", "league"], "law": ["court", "judge", "verdict", "lawsuit"]}
    common = ["table", "river", "morning", "letter", "road"]
    docs, labels = [], []
    for i in range(240):
        s = ("sport", "law", None)[i % 3]
        lines = [f"They saw the {rng.choice(terms[s] if s else common)} near the {rng.choice(common)}." for _ in range(5)] + [f"It was a {rng.choice(common)}."]
        if i % 2:
            lines.append("They lived a league away from here.")
        docs.append((i, " ".join(lines), "en", "x"))
        if s and i % 5:
            labels.append((i, s if i % 10 else "law"))
    docs += [(500, None, "en", "x"), (501, "", None, "x"), (None, docs[0][1], "en", "x")]
    labels += [(None, "law"), (3, None), (9999, "law"), (3, "nonsense"), *labels[:5]]
    d = spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string, lang string, subject string")
    a = spark.createDataFrame([("sport", "x"), ("law", "x"), (None, "x")], "subject string, description string")
    g = spark.createDataFrame([("ᎠᎡᎢ", "aei", "court"), (None, None, None)], "syllabary string, phonetic string, english string")
    args = spark.createDataFrame(labels, "doc_id bigint, subject string"), a, g
    model = subjects.fit_subjects(d, *args)
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(d, model).collect() if r.n_sentences >= 2}
    want = {(i, ("sport", "law")[i % 3]) for i in range(240) if i % 3 < 2}
    assert len(got ^ want) <= 3
    shares = pd.DataFrame(subjects.document_mixtures(d, model).collect(), columns=["doc_id", "subject", "share"])
    assert shares[(shares.doc_id % 3 == 0) & (shares.subject == "sport")].share.mean() > 3 * shares[(shares.doc_id % 3 == 1) & (shares.subject == "sport")].share.mean()
    assert subjects.fit_subjects(d, args[0].limit(0), a, g) is None and subjects.document_subjects(d, None).count() == 0
    assert subjects.document_subjects(d.limit(0), model).count() == 0


def test_every_query_is_registered():
    import __spark_entry__ as entry

    found = {n.split("_")[0] for n in entry.queries()}
    assert {f"p{n}" for n in range(1, 10)} <= found
    assert set(entry.oracle_sql()) <= set(entry.queries())
