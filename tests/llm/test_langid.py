"""Language identification against a plain version, and in languages without spaces."""

import math
import random
from collections import Counter

import pytest

from quire.llm import langid

DOCS = "doc_id long, text string, lang string, lang_pred string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 0.5) for i, t, lang in rows], DOCS)


def brute(rows, texts):
    """The same model and scores, all in dictionaries."""
    langs = sorted({lang for _, _, lang in rows if lang})
    words = {lang: Counter() for lang in langs}
    grams = {lang: Counter() for lang in langs}
    for _, text, lang in rows:
        for raw in (text or "").lower().split() if lang else ():
            if w := langid._word(raw):
                words[lang][w] += 1
                for k in range(1, 6):
                    for i in range(len(w) + 3 - k):
                        grams[lang][f" {w} "[i : i + k]] += 1

    def rates(counts):
        keys = {k for c in counts.values() for k in c}
        out = {}
        for k in keys:
            if sum(c[k] for c in counts.values()) >= 2:
                v = [math.log((counts[x][k] + 0.5) / (sum(counts[x].values()) + 0.5 * len(keys))) for x in langs]
                out[k] = [a - sum(v) / len(v) for a in v]
        return out

    by_word, by_gram = rates(words), rates(grams)

    def of(word):
        if word in by_word:
            return by_word[word]
        p, met = f" {word} ", []
        for i in range(len(p)):
            own = next((p[i : i + k] for k in range(min(5, len(p) - i), 0, -1) if p[i : i + k] in by_gram), None)
            met += [by_gram[own]] if own else []
        return [sum(m[j] for m in met) / len(met) if met else 0.0 for j in range(len(langs))]

    out = []
    for text in texts:
        own = [of(w) for w in map(langid._word, (text or "").lower().split()) if w]
        if not own:
            out.append(("und", 0.0))
            continue
        mean = [sum(v[j] for v in own) / len(own) * min(len(own), langid.ENOUGH) for j in range(len(langs))]
        best = max(range(len(langs)), key=lambda j: (mean[j], -j))
        out.append((langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)))
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    letters = {"a": "abcdef", "b": "defghi", "c": "aeimou"}
    text = lambda lang, n: " ".join("".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 6))) + r.choice(["", ",", "."]) for _ in range(n))
    rows = [(i, text(lang := r.choice("abc"), r.randrange(1, 30)), lang) for i in range(60)] + [(100, None, "a"), (101, "", "b"), (102, "zzz " * 9, None), (None, "aba bab", "a")]
    tests = [text(r.choice("abc"), r.randrange(0, 20)) for _ in range(60)] + [None, "", "12 !", "q" * 300, "abc" * 50, "Q"]
    docs = frame(spark, rows)
    model = langid.fit(docs)
    want = brute(rows, tests)
    got = langid.identify(frame(spark, [(i, t, None) for i, t in enumerate(tests)]), model).collect()
    for g, (lang, score) in zip(sorted(got, key=lambda g: g.doc_id), want, strict=True):
        assert (g.lang_pred, g.score) == (lang, pytest.approx(score, abs=1e-4))


def test_languages_without_spaces(spark):
    r = random.Random(2)
    signs = {"zh": "的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也得里后自以会", "ja": "のにはをたがでてとしれさあるいるもするからなことしていこの日本人年大中学生時", "en": None}
    text = lambda lang: "".join(r.choice(signs[lang]) for _ in range(r.randrange(80, 200))) if signs[lang] else " ".join(r.choice(["the", "of", "and", "word"]) for _ in range(30))
    rows = [(i, text(lang := r.choice(list(signs))), lang) for i in range(150)]
    model = langid.fit(frame(spark, rows))
    assert model.langs == ["en", "ja", "zh"]
    held = [(lang, text(lang)) for lang in signs for _ in range(20)]
    assert all(model.score(t)[0] == lang for lang, t in held)


def test_rare_languages_are_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 40)
    monkeypatch.setattr(langid, "EACH", 5)
    rows = [(i, f"the word of number {i % 7} and", "en") for i in range(400)] + [(1000 + i, "das wort und nicht", "de") for i in range(3)] + [(None, "le mot et la", "fr")] * 300
    own = langid.sampled(frame(spark, rows)).collect()
    count = Counter(x.lang for x in own)
    assert count == {"en": 13, "de": 3, "fr": 1}
    assert sorted(own) == sorted(langid.sampled(frame(spark, rows[::-1])).collect())
    assert langid.fit(frame(spark, rows)).score("und das wort")[0] == "de"


def test_names_that_clash(spark):
    docs = frame(spark, [(1, "the word", "en"), (2, "das wort", "de")])
    model = langid.fit(docs)
    with pytest.raises(ValueError):
        langid.identify(docs, model, docs.columns)
    out = langid.identify(docs, model, docs.columns, ("found", "sure"))
    assert out.columns == [*docs.columns, "found", "sure"] and out.count() == 2
