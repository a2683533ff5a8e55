"""Learned operators: toxicity, language and personal data, on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import charcrf, langid, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = {"en": "the of and to in that was for with this have from they which one had word".split(), "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein".split(), "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas".split()}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + (r.choice(["", "", "s", "en"]) if lang != "fr" else "") for _ in range(n)).capitalize() + "."


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.0) for i, t, lang in rows], DOCS)


ODD = [(9000, None, "en"), (9001, "", "en"), (9002, " \n\t", None), (9003, "12 345 !!!", "de"), (9004, "the " * 100_000, "en"), (9004, "the " * 100_000, "en"), (None, "und das ist nicht", None)]


def test_language(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang := r.choice(list(WORDS)), r.randrange(5, 60)), lang) for i in range(300)]
    docs = table(spark, rows + ODD)
    model = langid.fit(docs.where("doc_id is not null and (doc_id < 200 or doc_id >= 9000)"))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows) + len(ODD)
    held = {i: lang for i, _, lang in rows if i >= 200}
    assert np.mean([x.lang_pred == held[x.doc_id] for x in got if x.doc_id in held]) > 0.97
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (9000, 9001, 9002, 9003))
    assert by[9004].lang_pred == "en" and by[None].lang_pred == "de" and all(0 <= x.score <= 1 for x in got)
    assert model.score("derx undq nichtz")[0] == "de"  # unseen words, by their n-grams


def test_language_memory_starts_anew(monkeypatch, spark):
    r = random.Random(2)
    docs = table(spark, [(i, prose(r, lang := r.choice(list(WORDS)), 30), lang) for i in range(60)])
    model = langid.fit(docs)
    texts = [prose(r, "en", 50) for _ in range(20)]
    want = [model.score(t) for t in texts]
    monkeypatch.setattr(langid, "KEPT", 7)
    small = langid.Model(model.langs, model.words, model.grams, model.rates)
    assert [small.score(t) for t in texts] == [(a, pytest.approx(b)) for a, b in want]


def test_nothing_learned(spark):
    docs = table(spark, ODD)
    assert {x.lang_pred for x in langid.identify(docs, langid.fit(docs.where("false"))).collect()} == {"und"}
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(x.score < 0.01 for x in toxicity.scored(docs, lexicon).collect())
    none = table(spark, [])
    assert pii.train(none) is None
    assert toxicity.scored(none, lexicon).collect() == langid.identify(none, langid.fit(none)).collect() == pii.find(none, None).collect() == []


def test_fold():
    words = lambda s: toxicity.fold(s).split()
    assert words("ID1ОТ") == words("idiot") and words("ѕсum") == words("scum") and words("l0$er") == words("loser")
    assert words("word$$$ next!!") == words("word next")
    assert words(None) == words("") == []


def test_toxicity(spark):
    r = random.Random(3)
    bad = ["idiot", "scum", "moron", "vequta", "vequmo", "vequra"]
    rows, labels = [], []
    for i in range(400):
        toxic, words = i % 5 == 0, prose(r, "en", r.randrange(20, 80)).split()
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(bad))
        elif i % 7 == 0:
            words.insert(3, "scumble")  # harmless, though it holds an entry
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    rows += [(500, "you 1d10t and ѕcum of a m0ron, idiöt", "en"), (501, "vequnew vequother vequthird in the word", "fr"), (502, "scumble the scumble of scumble", "en")]
    docs = table(spark, rows + ODD)
    lexicon = toxicity.learn(docs, spark.createDataFrame([x for x in labels if x[0] % 4 != 2] + [(None, 1), (1, None), (0, 0)], "doc_id long, toxic int"))
    by = {x.doc_id: x.score for x in toxicity.scored(docs, lexicon).collect()}
    wrong = [i for i, t in labels if (by[i] >= toxicity.THRESHOLD) != bool(t)]
    assert len(wrong) <= 2
    assert by[500] >= 0.3 and by[501] >= 0.3 and by[502] < 0.3 and by[9000] < 0.3 and by[9004] < 0.3
    with pytest.raises(ValueError):
        toxicity.scored(docs, lexicon, docs.columns)  # they have a score
    kept = toxicity.scored(docs, lexicon, docs.columns, "_score")
    assert kept.columns == [*docs.columns, "_score"] and kept.count() == len(rows) + len(ODD)


def plain_evidence(found, folded):
    """Each hit held against every exception."""
    hits = [(end - n + 1, end, w) for end, (n, w) in found.iter(folded)]
    best = {}
    for a, z, w in hits:
        if w and not any(x <= a and z <= y and not v for x, y, v in hits):
            best[a] = max(best.get(a, 0.0), w)
    total = sum(best.values())
    return 1.0, float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(folded.split())))), float(total > 0)


def test_exceptions_against_brute_force():
    r = random.Random(6)
    lexicon = toxicity.Lexicon({" scum": 2.0, " scumb": 3.0, " b": 1.0, " idi ": 0.5}, [" scumbag ", " a scum ", " b b "], np.zeros(4))
    found = lexicon.automaton()
    for _ in range(500):
        folded = toxicity.fold(" ".join(r.choice(["scum", "scumbag", "a", "b", "idi", "scumble", ""]) for _ in range(r.randrange(12))))
        assert toxicity.evidence(found, folded) == plain_evidence(found, folded)


def test_long_texts_take_time_by_their_length():
    import time

    found = toxicity.Lexicon({" scum": 2.0}, [" scumbag "], np.zeros(4)).automaton()
    toxicity.evidence(found, toxicity.fold("scumbag scum " * 1000))
    began = time.perf_counter()
    toxicity.evidence(found, toxicity.fold("scumbag scum " * 100_000))
    assert time.perf_counter() - began < 10  # comparing all hits with all exceptions takes an hour
    spaced = toxicity.evidence(found, toxicity.fold("scum" + " " * 100_000 + "you"))
    assert spaced == toxicity.evidence(found, toxicity.fold("scum you"))


def test_a_repeated_id_teaches_once(spark):
    docs = table(spark, [(1, f"text {i}", "en") for i in range(50)] + [(2, "other", "en")])
    known = spark.createDataFrame([(1, 1), (2, 0)], "_id long, toxic int")
    assert sorted(r.toxic for r in toxicity._sampled(docs, known).collect()) == [0, 1]


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(0)
    tagger = charcrf.Tagger(hidden=4, seed=1)
    x, y = r.integers(0, charcrf.SYMBOLS, (3, 7)), np.zeros((3, 7), np.int8)
    y[0, 2:5] = [1, 2, 2]
    _, g = tagger.gradient(x, y)
    for name in tagger.p:
        flat = tagger.p[name].reshape(-1)
        for i in r.choice(len(flat), 3, replace=False):
            kept, e = flat[i], 1e-2
            flat[i] = kept + e
            up = tagger.gradient(x, y)[0]
            flat[i] = kept - e
            down = tagger.gradient(x, y)[0]
            flat[i] = kept
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_decoding_is_exhaustive_search():
    import itertools

    r = np.random.default_rng(0)
    tagger = charcrf.Tagger(hidden=4)
    e = r.standard_normal((2, 4, charcrf.LABELS)).astype(np.float32) * 3
    got = tagger.decode(e, np.array([4, 3]))
    moves = tagger.moves()
    for j, n in ((0, 4), (1, 3)):
        score = lambda s, j=j: sum(e[j, i, k] for i, k in enumerate(s)) + sum(moves[a, b] for a, b in itertools.pairwise((0, *s, 0)))
        best = max(itertools.product(range(charcrf.LABELS), repeat=n), key=score)
        assert got[j, :n].tolist() == list(best)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d))))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, z) for a, _, z, kind in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(4)
    pool = ["a", "Z", ".", "@", "-", "%", "+", " ", "(", ")", "1", "23", "255", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z", "10.0.0.1", "é", "\n", "🙂"]
    for _ in range(5000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(25)))
        assert pii.base_spans(text) == brute_spans(text), text


def luhn_card(r):
    d = [r.randrange(10) for _ in range(15)]
    total = sum(n if i % 2 else n * 2 - 9 * (n > 4) for i, n in enumerate(reversed(d)))
    return "".join(map(str, d)) + str(-total % 10)


@pytest.fixture(scope="module")
def personal():
    r = random.Random(5)
    rows = []
    for i in range(240):
        words = prose(r, "en", 40).split()
        for _ in range(2):
            item = r.choice([f"u{r.randrange(999)}@mail{r.randrange(9)}.com", ".".join(str(r.randrange(256)) for _ in range(4)), luhn_card(r), f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", str(r.randrange(10**6))])
            words.insert(r.randrange(len(words)), item)
        rows.append((i, " ".join(words), "en"))
    return rows


def test_personal_data(spark, personal, monkeypatch):
    monkeypatch.setattr(pii, "PASSAGES", 300)
    docs = table(spark, personal + ODD + [(9100, "9" * 3000 + " a@b.co " + "x" * 3000, "en")])
    tagger = pii.train(docs)
    got = {x.doc_id: x for x in pii.find(docs, tagger).collect()}
    texts = dict([(i, t) for i, t, _ in personal] + [(9100, "9" * 3000 + " a@b.co " + "x" * 3000)])
    for i, t in texts.items():
        want = ",".join(f"{k}:{a}:{z}" for k, a, z in brute_spans(t))
        assert got[i].base == want and set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert got[9000].base == got[9000].spans == got[9001].spans == ""
    texts = ["please write to u77@mail3.com about the word", "call +1 (415) 555-2671 for the"]  # the network alone, without the patterns
    found = [pii.added_spans(t, f, []) for t, f in zip(texts, pii.tagged(tagger, texts), strict=True)]
    assert [k for k, _, _ in found[0]] == ["email"] and [k for k, _, _ in found[1]] == ["phone"]
    clean = pii.redact(docs, tagger)
    assert clean.columns == docs.columns
    by = {x.doc_id: x for x in clean.collect()}
    assert "[EMAIL]" in by[9100].text and not any(brute_spans(by[i].text) for i, _, _ in personal) and by[0].n_chars == len(by[0].text) and by[9000].text is None
