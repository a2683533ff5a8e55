"""op2 against a plain version of what it learns and how it scores, and its folding over all of Unicode."""

import math
import random
import unicodedata

import numpy as np
import pytest

from quire.llm import toxicity as T

BAD = ["scumbag", "vileword", "gronkish"]


def corpus(n=400):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "sel") for b in ("ka", "ne", "vo") for c in ("r", "st", "n")] + ["harbour"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([1, 8, 40, 200]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(BAD).replace("s", rng.choice("s$5ѕ")) + rng.choice(["", "s", "er", "ing", "y", "ed"]))
        elif rng.random() < 0.04:
            text.append("scumbagel")
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(text), int(toxic)))
    return rows


def plain_fold(text):
    kept = []
    for i, c in enumerate(text or ""):
        if c in "@$!|":
            j = i
            while j < len(text) and text[j] in "@$!|":
                j += 1
            if not (j < len(text) and (text[j].isalnum() or text[j] == "_")):
                c = " "
        kept.append(T._FOLDS[ord(c)])
    return f" {''.join(kept)} "


def plain_entries(rows):
    """Log odds of every beginning of a word, counted document by document."""
    n, seen = [0, 0], {}
    for _, text, toxic in rows:
        n[toxic] += 1
        own = set()
        for w in plain_fold(text).split():
            own |= {f" {w} ", *(f" {w[:k]}" for k in range(4, 13) if len(w) >= k)}
        for f in own:
            seen.setdefault(f, [0, 0])[toxic] += 1
    out = {}
    for f in sorted(seen, key=lambda f: (len(f.rstrip()), f)):
        clean, toxic = seen[f]
        w = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1)) - 1.5 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        if toxic >= 2 and toxic > clean and w >= 1.5 and all(w > out[f[:k]] + 0.7 for k in range(2, len(f)) if f[:k] in out):
            out[f] = w
    return out


def plain_evidence(lexicon, text):
    folded = plain_fold(text)
    spared = [(i, i + len(x)) for x in lexicon.exceptions for i in range(len(folded)) if folded.startswith(x, i)]
    best = {}
    for x, w in lexicon.entries.items():
        for i in range(len(folded)):
            if folded.startswith(x, i) and not any(a <= i and i + len(x) <= z for a, z in spared):
                best[i] = max(best.get(i, 0.0), w)
    total = sum(best.values())
    return [1.0, math.log1p(total), math.log1p(100 * total / max(1, len(folded.split()))), float(total > 0)]


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return rows, df, T.learn(df.drop("toxic"), df.select("doc_id", "toxic"))


def test_entries_are_those_of_plain_counting(learned):
    rows, _, lexicon = learned
    want = plain_entries(rows)
    assert set(lexicon.entries) == set(want) and all(lexicon.entries[f] == pytest.approx(w) for f, w in want.items())
    assert any(f.strip() == T.fold("scumbag").strip()[: len(f.strip())] for f in want) and any("bagei" in x for x in lexicon.exceptions)  # l and i are one letter


def test_scores_are_those_of_plain_matching(learned):
    rows, df, lexicon = learned
    texts = [*[(i, t) for i, t, _ in rows], (900, None), (901, ""), (902, "scumbagel scumbag"), (903, "$cumb@g!"), (904, "x " * 3000 + "vileword")]
    got = {r.doc_id: r.score for r in T.scored(df.sparkSession.createDataFrame(texts, "doc_id long, text string"), lexicon).collect()}
    for i, t in texts:
        p = 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(plain_evidence(lexicon, t), lexicon.coefficients))))))
        assert got[i] == pytest.approx(p, abs=1e-9)
    assert got[902] > 0.3 > got[901] and got[904] > got[901]


@pytest.mark.parametrize("hidden", ["𝐬𝐜𝐮𝐦", "Ꮪcum", "scսm", "ｓｃｕｍ", "ѕсum", "s​ćum", "ⓢⓒⓤⓜ", "ꜱᴄᴜᴍ", "$cum", "5CUM", "s⁠c️um"])
def test_folding(hidden):
    assert T.fold(hidden).split() == ["scum"]


def test_folding_of_every_character():
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c) not in ("Cs", "Cn", "Co"):
            got = T._Folds()[code]
            assert all(x == " " or x.isalnum() and x == x.lower() for x in got), (hex(code), got)
