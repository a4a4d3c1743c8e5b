import pytest
from hypothesis import given, settings, strategies as st

from pictorium.llm import leaks, readability, safety
from pictorium.llm.plaintext import words
from pictorium.llm.safety_seeds import seeds

ITEM = "The ivory frame from Gangeikour was matched with a fox study by Ganoleroud after 51 seasons. According to Klisnirnlos, the puppet panel was cut into 48 pieces and sent to Jarnbynd before 1840."
OTHER = "The olive frame from Thoxsyd was matched with an owl study by Fousolustoud after 10 seasons. According to Gemnend, the tiger panel was cut into 20 pieces and sent to Widreik before 1972."
NOISE = "We met at the harbour and drew clouds until the light was gone. "


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", max_size=400), st.lists(st.text("abc ", min_size=6, max_size=12), min_size=1, max_size=8, unique=True))
def test_search_finds_what_find_finds(text, patterns):
    got = sorted(zip(*(x.tolist() for x in leaks.WuManber(patterns).find(text))))
    want = sorted((k, n) for n, p in enumerate(patterns) for k in range(len(text)) if text.startswith(p, k))
    assert got == want


def test_search_over_many_lanes():
    text = ("xyzzy" * 400 + "needle-one" + "q" * 300 + "another needle") * 5
    starts, numbers = leaks.WuManber(["needle-one", "another needle"]).find(text)
    assert numbers.tolist() == [0, 1] * 5 and all(text.startswith(["needle-one", "another needle"][n], s) for s, n in zip(starts.tolist(), numbers.tolist()))


def test_the_shift_table_grows_with_the_patterns():
    patterns = [f"pattern{k:07d}" for k in range(30_000)]
    search = leaks.WuManber(patterns)
    assert search.bits > leaks.TABLE_BITS
    starts, numbers = search.find("xx pattern0000007 yy pattern0029999 pattern003000")
    assert starts.tolist() == [3, 21] and numbers.tolist() == [7, 29_999]


def wide(text):
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


CASES = {
    "whole": ITEM, "case": ITEM.upper(), "wide": wide(ITEM), "markup": "<p>" + ITEM.replace(" a ", " <b>a</b> ") + "</p>", "soft": ITEM.replace("e", "e­"), "lookalike": ITEM.replace("e", "е").replace("o", "о"),
    "lines": ITEM.replace(" ", "\n  "), "order": ITEM.split(". ")[1] + " " + NOISE + ITEM.split(". ")[0], "half": ITEM.split(". ")[0], "stars": ITEM.replace(" from", " **from**"),
    "changed": ITEM.replace("matched", "paired").replace("pieces", "really parts").replace("study", "study bright"),
}


@pytest.mark.parametrize("name", CASES)
def test_disguised_items_are_found(name):
    items = leaks.Items.prepare([(1, ITEM), (2, OTHER), (3, NOISE * 2)])
    got = {(n, i) for n, i, *_ in items.leaked([NOISE * 3, NOISE * 3 + CASES[name] + " " + NOISE * 3])}
    assert (1, 1) in got and (1, 2) not in got and not any(n == 0 and i in (1, 2) for n, i in got)


def test_quotes_and_same_frames_are_no_leaks():
    items = leaks.Items.prepare([(1, ITEM), (2, OTHER)])
    quote = " ".join(ITEM.split()[:9])
    frame = "The mint frame from Prexkirma was matched with a wolf study by Brandtaeth after 31 seasons. According to Jemmaev, the sailor panel was cut into 45 pieces and sent to Tiatherid before 1768."
    assert list(items.leaked([NOISE + quote + " " + NOISE, frame, None, "", "   "])) == []


def test_leaks_operator(spark):
    docs = spark.createDataFrame([(1, NOISE + ITEM, 5, "a"), (1, NOISE + ITEM, 5, "a"), (2, None, 5, "b"), (3, "", None, None), (None, ITEM, 1, "c"), (4, NOISE * 40_000 + ITEM, 1, "d")], "doc_id bigint, text string, key int, body string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (None, OTHER), (9, "too short")], "item_id bigint, item_text string")
    rows = leaks.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 7), (1, 7), (4, 7)] and all(r.words_found == r.item_words for r in rows)
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), items).count() == 0
    parts = leaks.leaks(docs, items, at_once=1).collect()
    assert sorted((r.doc_id, r.item_id) for r in parts) == [(1, 7), (1, 7), (4, 7)]


def test_folding():
    assert words("It&#x27;s a <b>Tеst</b>​ of ﬁne­ ＷＯＲＤＳ, hy-\nphen") == ["its", "a", "test", "of", "fine", "words", "hyphen"]


# ---------------------------------------------------------------- safety

NONE = ["I drew a fox.", "The sky is rose and the boat is red.", "We met at the harbour and drew clouds.", "Use a soft pen and wipe it.", "My lamp broke last night.", "The scan lost some blue.", "People often forget that glazing works.", "It took me five tries."]
BAD = ["You are a total idiot and your lines are crap.", "Shut up, you stupid bastard.", "You draw like an imbecile.", "Imagine being such a moron, so get lost."]


@pytest.fixture(scope="module")
def model():
    rated = [(t, "none") for t in NONE] + [(t, "abuse") for t in BAD]
    return safety.train(rated, seeds(), NONE)


def test_unseen_misspellings_and_disguises(model):
    bad = ["You are a total idioot.", "You are a total i d i o t and your lines are crap", "YOU ARE A T0TAL 1D10T", "You are a total idi​ot.", "You stupid bastardd, shut up", NONE[2] * 30 + BAD[1] + NONE[3] * 30, "no stops here " * 30 + "you are a total idiot and your lines are crap " + "no stops here " * 30]
    scores = 1 - model.score_many(bad)[:, 0]
    assert (scores > safety.THRESHOLD).all(), scores
    good = 1 - model.score_many(NONE + ["The sky is blue and the fox is red."])[:, 0]
    assert (good < safety.THRESHOLD).all(), good


def test_wrong_ratings_are_dropped():
    rated = [(t, "none") for t in NONE] + [(t, "abuse") for t in BAD] + [("You are a stupid ugly idiot and a moron.", "none")]
    kept, _ = safety.cleaned(rated, seeds(), NONE)
    assert ("You are a stupid ugly idiot and a moron.", "none") not in kept and len(kept) >= len(rated) - 4


def test_scores_of_odd_texts(spark, model):
    rows = [(1, None, "x", 0.0), (2, "", None, 1.0), (3, "🎨 !!", "y", None), (4, "a" * 400_000, "z", None), (5, BAD[0], "z", None), (5, BAD[0], "z", None), (6, NONE[0], None, None)]
    df = spark.createDataFrame(rows, "id bigint, t string, source string, unsafe double")
    got = sorted((r["id"], r["unsafe"] >= safety.THRESHOLD) for r in safety.scored(df, model, ["t"], ["id", "source"]).collect())
    assert got == [(1, False), (2, False), (3, False), (4, False), (5, True), (5, True), (6, False)]
    assert safety.scored(df.limit(0), model, ["t"], ["id"]).count() == 0
    two = safety.scored(df.withColumnRenamed("unsafe", "u"), model, ["t", "source"], ["id"])
    assert two.where("unsafe > 0.6").count() == 2
    rates = {r["source"]: (r["rows"], r["flagged"]) for r in safety.rates(safety.scored(df, model, ["t"], ["source"]), ["source"]).collect()}
    assert rates["z"] == (3, 2) and rates[None] == (2, 0)


# ---------------------------------------------------------------- reading level

EASY = "I drew a fox. It was fun. Use a red pen. The sky is blue. "
MIDDLE = "After nine hours the kettle still looked restless, so I cropped the hair and moved on, mostly because of the winter sun. "
HARD = "Insofar as the picture's iconography remains legible beneath subsequent campaigns of restoration, it presupposes a heterogeneous epistemological apparatus. Stratigraphy corroborates conjectural attribution. "
SAMPLES = [(EASY, "beginner"), (EASY[14:], "beginner"), (MIDDLE, "general"), (MIDDLE * 2, "general"), (HARD, "expert"), (HARD[60:], "expert")]


@pytest.mark.parametrize("word,count", [("fox", 1), ("make", 1), ("table", 2), ("stratigraphy", 4), ("painted", 2), ("looked", 1), ("area", 2), ("quiet", 2), ("iconography", 5)])
def test_syllables(word, count):
    assert abs(readability.syllables(word) - count) <= (1 if word in ("area", "quiet", "table") else 0)


def test_formulas_rise_with_demand():
    easy, hard = (readability.grades(readability.np.array([readability.counts(s)]))[0] for s in ("I drew a fox.", HARD))
    assert (hard > easy).all()


def test_bands_and_languages():
    model = readability.BandModel.fit(SAMPLES)
    got = readability.rate([EASY * 3, MIDDLE * 3, HARD * 3, HARD * 3 + EASY, "Ich habe heute einen kleinen Fuchs mit Tusche gezeichnet und die Farben sind zu dunkel.", None, "  ", "🎨"], model)
    assert [g[1] for g in got[:4]] == ["beginner", "general", "expert", "expert"]
    assert [g[0] for g in got] == ["en", "en", "en", "en", "de", None, None, None]
    assert [g[5] for g in got[5:7]] == [0, 0]


def test_run_ons_and_giants_end():
    model = readability.BandModel.fit(SAMPLES)
    texts = ["word " * 200_000, "\n" * 200_000 + " " * 200_000, "x" * 300_000, HARD * 500, (EASY.replace(".", "") * 50).lower()]
    got = readability.rate(texts, model)
    assert got[3][1] == "expert" and got[1][1] is None


def test_levels_operator(spark):
    docs = spark.createDataFrame([(1, HARD, "a", "old", 9.0), (2, None, "b", None, None), (3, EASY, None, "x", 1.0)], "doc_id bigint, text string, source string, band string, grade double")
    samples = spark.createDataFrame([*SAMPLES, (None, "general"), ("x", "other"), ("y", None)], "sample_text string, band string")
    got = {r.doc_id: r for r in readability.reading_levels(docs, samples).collect()}
    assert got[1].band == "expert" and got[2].band is None and got[3].band == "beginner" and got[1].source == "a"
    assert readability.reading_levels(docs.limit(0), samples).count() == 0
