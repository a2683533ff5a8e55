"""Personal data: patterns with checks, and what a character-level BiLSTM-CRF adds to them.

The network is trained on passages of a bounded sample of the documents. Their labelled spans are the patterns' own and, put
into passages in the places of these or between words, spans of the same kinds that are written as no pattern has
them: with "at" and "dot", signs in brackets, other separators, without a country's plus, in words for digits. Beside
them stand harmless strings of digits. The network reads texts of any length in overlapping windows: a
position's scores come from the window in whose middle it lies, and one decoding over the whole text, with the
transitions, settles what the windows say. Windows without the digits, signs and words that a plausible span is made of are left out of that.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .charcrf import KINDS, Tagger, label_row, spans_of, symbols
from .util import Staged

#: Documents that training passages are taken from, and passages with and without spans trained on (those of least hash); examples made in all, their length, and rounds over them.
SAMPLE_DOCS, PASSAGES, EXAMPLES, PASSAGE, EPOCHS = 4000, 600, 5000, 96, 12
#: Characters of a window and of what two windows share; characters of texts read at a time, and windows.
WINDOW, SHARED, CHARS, ROWS = 1024, 96, 1 << 20, 1280
#: A window whose last span is no further than this from gaining keeps its scores, in case it gains in the next; others are read again then.
KEEP = 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGITS = re.compile("[0-9]"), re.compile("[0-9]+")
# English words for the digits.
_SPOKEN = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_AS_WORD = re.compile(rf"\b({'|'.join(_SPOKEN)})\b", re.IGNORECASE)


_AT, _DOT = re.compile(r"[@＠#]|\bat\b", re.IGNORECASE), re.compile(r"\.|\bdot\b", re.IGNORECASE)
_LETTER, _WORD = re.compile(r"\w"), re.compile(r"[^\W\d_]+")
#: Words that may stand between the digits of a kind.
_BETWEEN = {"ip": {"dot"}, "card": {"dot", *_SPOKEN}, "phone": {"plus", "dot", *_SPOKEN}}
#: Numbers that have digits enough for a telephone: days, with a time or another day after them, years, and numbers grouped by thousands.
_DAY = r"(\d{4}([-./ ])\d\d?\2\d\d?|\d\d?([-./ ])\d\d?\3(\d{4}|\d\d))"
_YEAR = r"(1[5-9]|20)\d\d"
_NO_PHONE = re.compile(rf"{_DAY}(\W+(\d\d?:\d\d(:\d\d)?|\d{{1,4}}[-./ ]\d\d?[-./ ]\d{{1,4}}))?|{_YEAR}(\W+{_YEAR})+|\d{{1,3}}(?P<by>[ ,.'\u00a0])\d{{3}}((?P=by)\d{{3}})*((?!(?P=by))[.,]\d+)?")
# Endings of names in the network's name system, as addresses that are spelled out have them.
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv eu uk de fr es it nl be ch at pt pl se no dk fi ie ru ua cz gr ro hu us ca mx br ar cl au nz jp cn kr in za example test".split())
#: What before a number says that it numbers a thing, not a telephone.
_THING = re.compile(r"\b(order|invoice|ticket|case|ref|reference|serial|isbn|issn|part|item|tracking|article|patent)\b\W*((number|no|nr|num|id)\b)?\W*\Z", re.IGNORECASE)


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return sum(back[0::2]) % 10 == -sum(d * 2 - 9 * (d > 4) for d in back[1::2]) % 10


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """As a search for local part, @ and domain would find them: at each @ the part before it can start no earlier than the characters allow or the last match ends."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", a, done
        at = text.find("@", max(at + 1, done))


def _octets(text: str) -> bool:
    """Whether each part is at most 255, however many zeros it begins with."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind, in code points."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    """What a span that only the network proposes must be: the digits or words that its kind has, and between them signs and the words that stand for some, nothing else."""
    if kind == "email":
        at = _AT.search(text)
        dot = at and _DOT.search(text, at.end())
        if not (dot and text[0].isalnum() and _LETTER.search(text, 0, at.start()) and _LETTER.search(text, at.end(), dot.start()) and _LETTER.search(text, dot.end())):
            return False
        last = _WORD.findall(text)[-1]
        return at[0] in "@＠#" or last.lower() in ENDINGS and last in (last.lower(), last.upper())  # words are believed only of a name that there can be
    if any(w.lower() not in _BETWEEN[kind] for w in _WORD.findall(text)):
        return False
    d = _DIGITS.findall(text)
    if kind == "ip":
        return len(d) == 4 and _octets(".".join(d))
    digits = "".join(d)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) + len(_AS_WORD.findall(text)) <= 15 and not _NO_PHONE.fullmatch(text)


#: What plausible spans are made of: digits and words for them, signs that stand for an at-sign, the word, and a dot before an ending.
_MAKINGS = {
    "digits": re.compile("[0-9]+"),
    "spoken": _AS_WORD,
    "sign": re.compile("[@＠#]"),
    "at": re.compile(r"\b[aA][tT]\b"),
    "ending": re.compile(rf"(?:\.|\b[dD][oO][tT]\b)\W*(?:{'|'.join(sorted(ENDINGS))}|{'|'.join(sorted(x.upper() for x in ENDINGS))})\b"),
}


def _near(counts: np.ndarray) -> np.ndarray:
    """Sums over each window and those beside it."""
    out = counts.copy()
    out[1:] += counts[:-1]
    out[:-1] += counts[1:]
    return out


def sought(text: str, windows: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The windows of a text that have, with those beside them, the makings of a plausible span, and their neighbours: such a span, if it is no longer than a window, lies in these alone."""
    cuts = np.array(windows, np.int64)
    has = {}
    for name, pattern in _MAKINGS.items():
        own = [m.span() for m in pattern.finditer(text)]
        at = np.array([x for x, _ in own], np.int64)
        sums = np.concatenate(([0], np.cumsum([z - x if name == "digits" else 1 for x, z in own], dtype=np.int64)))
        has[name] = sums[np.searchsorted(at, cuts[:, 1])] - sums[np.searchsorted(at, cuts[:, 0])]
    numbers = has["digits"] + has["spoken"]
    some = (has["sign"] > 0) | (_near(numbers) >= 4) & (numbers > 0) | (has["at"] > 0) & (_near(has["ending"]) > 0)
    return _near(some.astype(np.int64)) > 0


def _windows(length: int) -> list[tuple[int, int, int, int]]:
    """(start, end, from, to) of each window of a text: it answers for the positions from .. to, whose middle it is."""
    step, out = WINDOW - SHARED, []
    for a in range(0, max(1, length - SHARED), step):
        z = min(length, a + WINDOW)
        out.append((a, z, a + SHARED // 2 if a else 0, z - SHARED // 2 if z < length else z))
    return out


def _read(codes: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of `cuts`, their characters) of windows (start, end, ...) in `codes`, ROWS windows at a time, like lengths together."""
    lengths = cuts[:, 1] - cuts[:, 0]
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), ROWS):
        some = order[at : at + ROWS]
        wide = int(lengths[some].max())
        place = np.arange(wide)
        x = codes[np.minimum(cuts[some, :1] + place, len(codes) - 1)]
        x[place[None] >= lengths[some, None]] = 0
        yield some, x


def _may_hold(tagger: Tagger, codes: np.ndarray, cuts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The windows that a span of the best labelling may touch: those where the best span that begins before their end and ends after their start gains.

    Also the scores of those of which that is known from themselves, or likely.
    """
    sums, kept = np.zeros((len(cuts), 4, len(KINDS)), np.float64), {}
    for some, x in _read(codes, cuts):
        e, own = tagger.summarised(x, cuts[some, 2] - cuts[some, 0], cuts[some, 3] - cuts[some, 0])
        sums[some] = own.transpose(2, 0, 1)
        for j in np.flatnonzero(((sums[some, 0] > 0) | (sums[some, 1] > -KEEP)).any(1)).tolist():
            a, _, s, z = cuts[some[j]].tolist()
            kept[int(some[j])] = e[s - a : z - a, :, j].copy()
    best, last, total, prefix = sums.transpose(1, 0, 2).copy()
    for i in np.flatnonzero(doc[1:] == doc[:-1]) + 1:  # what comes in from the window before
        best[i] = np.maximum(best[i], last[i - 1] + prefix[i])
        last[i] = np.maximum(last[i], last[i - 1] + total[i])
    after = np.zeros_like(total)
    for i in (np.flatnonzero(doc[1:] == doc[:-1]))[::-1]:
        after[i] = np.maximum(prefix[i + 1], total[i + 1] + after[i + 1])
    return ((best > 0) | (last + after > 0)).any(1), kept


def tagged(tagger: Tagger, texts: list[str], wanted: Callable[[str, list], np.ndarray] | None = None) -> list[list[tuple[str, int, int]]]:
    """The network's spans of each text: the best labelling of the whole of it, with O where windows are not `wanted`.

    All windows are read for bounds on what spans can gain in them, a few numbers each; the scores of those that
    a span may touch are kept or found again, and decoded where one may lie.
    """
    coded = [symbols(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(c) for c in coded])))
    codes = np.concatenate([*coded, np.zeros(1, np.uint8)])
    own = []
    for i, (a, c) in enumerate(zip(starts.tolist(), coded, strict=False)):
        cuts = _windows(len(c)) if len(c) else []
        some = wanted(texts[i], cuts) if wanted and cuts else np.ones(len(cuts), bool)
        own += [(a + w[0], a + w[1], a + w[2], a + w[3], i) for w, chosen in zip(cuts, some.tolist(), strict=True) if chosen]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not own:
        return out
    cuts, doc = np.array(own, np.int64)[:, :4], np.array(own, np.int64)[:, 4]
    some, kept = _may_hold(tagger, codes, cuts, doc)
    cuts, doc, known = cuts[some], doc[some], [kept.get(i) for i in np.flatnonzero(some).tolist()]
    if not len(cuts):
        return out
    gap = np.concatenate(([True], (cuts[1:, 2] != cuts[:-1, 3]) | (doc[1:] != doc[:-1])))
    place = np.cumsum(cuts[:, 3] - cuts[:, 2] + gap) - (cuts[:, 3] - cuts[:, 2])  # where a window's scores begin; what lies between runs of windows is O
    scores = np.full((int(place[-1] + cuts[-1, 3] - cuts[-1, 2]), tagger.p["bias"].shape[0]), -1e5, np.float32)
    scores[:, 0] = 0
    for i, e in enumerate(known):
        if e is not None:
            scores[place[i] : place[i] + len(e)] = e
    again = np.array([i for i, e in enumerate(known) if e is None], np.int64)
    for rows, x in _read(codes, cuts[again]):
        e = tagger.emissions(x)
        for j, i in enumerate(again[rows].tolist()):
            a, _, s, z = cuts[i].tolist()
            scores[place[i] : place[i] + z - s] = e[s - a : z - a, :, j]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], tagger.live(scores), [0]))))
    runs = np.stack([edges[::2], edges[1::2]], 1)
    runs = runs[np.argsort(runs[:, 1] - runs[:, 0], kind="stable")]
    at = 0
    while at < len(runs):
        own = runs[at : at + 8 * ROWS]
        lengths = own[:, 1] - own[:, 0]
        own = own[lengths <= 2 * lengths[0] + 8]
        at, lengths = at + len(own), own[:, 1] - own[:, 0]
        wide = np.arange(int(lengths.max()))
        best = tagger.decode(scores[np.minimum(own[:, :1] + wide, len(scores) - 1)], lengths)
        for j in np.flatnonzero(best.any(1)).tolist():
            i = int(np.searchsorted(place, own[j, 0], side="right")) - 1
            off = int(own[j, 0] - place[i] + cuts[i, 2] - starts[doc[i]])
            out[doc[i]] += [(k, off + x, off + y) for k, x, y in spans_of(best[j, : lengths[j]])]
    return [sorted(x, key=lambda s: s[1]) for x in out]


def _pieces(texts: list[str | None]) -> Iterator[list[int]]:
    """Runs of texts of about CHARS characters together; a longer text is alone."""
    own, n = [], 0
    for i, t in enumerate(texts):
        if own and n + len(t or "") > CHARS:
            yield own
            own, n = [], 0
        own.append(i)
        n += len(t or "")
    if own:
        yield own


def added_spans(text: str, found: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The network's spans without the space and stops at their ends, if they are no part of a word and overlap no span of the patterns, each of its own kind if it is plausible as that, else of the first kind of number that it is plausible as."""
    out = []
    for kind, s, e in found:
        while s < e and (text[s].isspace() or text[s] in ".,;:-"):
            s += 1
        while s < e and (text[e - 1].isspace() or text[e - 1] in ".,;:-"):
            e -= 1
        if s == e or any(x < e and s < y for _, x, y in base) or text[max(0, s - 1) : s].isalnum() or text[e : e + 1].isalnum():
            continue
        kinds = [kind] if kind == "email" else [kind, *(k for k in KINDS[1:] if k != kind)]
        kind = next((k for k in kinds if plausible(k, text[s:e])), None)
        if kind and (kind != "phone" or not _THING.search(text, max(0, s - 40), s)):
            out.append((kind, s, e))
    return out


def all_spans(tagger: Tagger | None, texts: list[str | None]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    out: list[tuple[list, list]] = []
    for own in _pieces(texts):
        for i, found in zip(own, tagged(tagger, [texts[i] or "" for i in own], sought), strict=True):
            more = added_spans(texts[i], found, base[i]) if found else []
            out.append((base[i], sorted([*base[i], *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base[i]))
    return out


def _number(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _one(r: np.random.Generator, *of: str) -> str:
    return of[int(r.integers(len(of)))]


def disguised(r: np.random.Generator, kind: str, words: list[str]) -> str:
    """A span of `kind` that no pattern finds."""
    if kind == "email":
        name = _one(r, "", "", ".", "_").join([_one(r, *words).lower() for _ in range(int(r.integers(1, 3)))]) + _one(r, "", "", _number(r, 2))
        parts = [_one(r, *words).lower(), *([_one(r, *words).lower()] if r.random() < 0.2 else []), _one(r, "com", "org", "net", "edu", "io", "de", "fr", "co", "info", "example", "test")]
        a, z = _one(r, "()", "[]", "{}", "<>")
        at = _one(r, " at ", " AT ", f" {a}at{z} ", f"{a}at{z}", f" {a}AT{z} ", " @ ", f"{a}@{z}", f" {a}@{z} ", "＠", " @", "@ ", "#", " # ", f" {a}at{z} ", " at ")
        dot = _one(r, " dot ", " DOT ", f" {a}dot{z} ", f"{a}dot{z}", f"{a}.{z}", " . ", ".") if at.strip() not in ("@", "＠") else _one(r, " . ", ".", " .", " dot ")
        return (name if name.strip("._") else "info") + (" @ " if at == "@ " and dot == "." else at) + dot.join(parts)
    if kind == "ip":
        return _one(r, " . ", "[.]", "(.)", " dot ", ". ", " .", "[dot]", "{.}").join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        d = _number(r, 15)
        d = "4" + d[1:] if r.random() < 0.5 else "5" + d[1:]
        d += next(c for c in "0123456789" if luhn(d + c))
        return _one(r, ".", "/", "_", "  ", " - ", "\u00a0", ":", ", ", "*").join(d[i : i + 4] for i in range(0, 16, 4))
    lead = _one(r, "", "", "0", "00", "1")
    groups = [_number(r, k) for k in ((3, 3, 4), (3, 4), (2, 4, 4), (3, 3, 3), (4, 6), (2, 3, 2, 2), (3, 2, 2, 3))[int(r.integers(7))]]
    way = r.random()
    if way < 0.3:
        return f"({lead}{groups[0]}){_one(r, ' ', '', '-')}" + _one(r, "-", " ", ".").join(groups[1:])
    if way < 0.75:
        return _one(r, lead, f"{lead}{_one(r, '-', ' ', '.')}" if lead else "", f"plus {r.integers(1, 99)} ", f"+{r.integers(1, 99)}/") + _one(r, "-", " ", ".", "/", " - ", "–").join(groups)
    if way < 0.9:
        return _one(r, "-", " ", ", ").join(_SPOKEN[int(c)] for c in "".join(groups))
    return "+" + _one(r, " ", "_", "/", "·").join([str(r.integers(1, 99)), *groups]).replace(" ", "  ")


def harmless(r: np.random.Generator, words: list[str]) -> str:
    """A string with digits, signs or words of those that is no personal data."""
    n = lambda a, b: str(r.integers(a, b))
    way = int(r.integers(21))
    if way > 15:
        return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(1, 10)))) for _ in range(int(r.integers(1, 6))))
    return (
        lambda: f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}",
        lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}",
        lambda: f"{n(0, 24)}:{n(10, 60)}" + _one(r, "", f":{n(10, 60)}"),
        lambda: f"${n(1, 999)},{n(100, 999)}.{n(10, 99)}",
        lambda: f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}",
        lambda: f"{n(1, 500)}-{n(1, 500)}",
        lambda: f"{n(1, 99)}%",
        lambda: f"{n(0, 99)}.{n(0, 9999)}",
        lambda: "".join(_one(r, *"0123456789abcdef") for _ in range(int(r.integers(8, 33)))),
        lambda: f"{_one(r, '#', 'no. ', 'id ', 'AB-')}{_number(r, int(r.integers(3, 9)))}",
        lambda: f"{_one(r, *words)} at {_one(r, *words)} " + _one(r, "", f"at {_one(r, *words)}"),
        lambda: f"{_one(r, *_SPOKEN)} {_one(r, *words)} {_one(r, 'and', 'or', 'of')} {_one(r, *_SPOKEN)}",
        lambda: f"@{_one(r, *words)}",
        lambda: f"{n(1, 99)}, {n(1, 99)}, {n(1, 99)}" + _one(r, "", f", {n(1, 99)}", f" and {n(1, 99)}"),
        lambda: f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}" + _one(r, " ", " to ", " we met ", "/", ", ") + _one(r, f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 29)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", n(1, 99)),
        lambda: f"{_one(r, 'section', 'chapter', 'version', 'table', 'fig.')} {n(1, 20)}.{n(1, 20)}" + _one(r, "", f".{n(1, 20)}", f".{n(1, 20)}.{n(1, 300)}"),
    )[way]()


def example(r: np.random.Generator, passage: str, spans: list[tuple[str, int, int]], words: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A passage of PASSAGE characters at most with labelled spans: its own with other digits and letters, disguised ones, or harmless strings."""
    way = r.random()
    if spans and way < 0.3:
        return _varied(passage, spans, r), spans
    if spans and way < 0.5:
        kind, a, z = spans[int(r.integers(len(spans)))]
    else:
        gaps = [i for i, c in enumerate(passage) if c == " "] or [len(passage)]
        a = z = gaps[int(r.integers(len(gaps)))]
        kind = None if way > 0.76 else _one(r, *KINDS)
    put = harmless(r, words) if kind is None else disguised(r, kind, words)
    before, after = (passage[:a], " " if a == z and a else ""), (" " if a == z else "", passage[z:])
    if a == z and r.random() < 0.3:
        after = (_one(r, ". ", ", ", ") ", "%%% ", "; ", "$$$ "), after[1].lstrip())
    room = max(0, PASSAGE - len(put) - 4)
    left = int(r.integers(0, room + 1))
    start = "".join(before)[-left:] if left else ""
    text = (start + put + "".join(after))[:PASSAGE]
    own = [(k, x - max(0, a - left + len(before[1])), y - max(0, a - left + len(before[1]))) for k, x, y in spans if y <= a]
    own = [(k, x, y) for k, x, y in own if y > 0]
    shift = len(start) + len(put) + len(after[0]) - z if a != z or after[0] == " " else None
    own += [(kind, len(start), len(start) + len(put))] if kind else []
    if shift is not None:
        own += [(k, x + shift, y + shift) for k, x, y in spans if x >= z]
    elif any(x >= z for _, x, _ in spans):
        text = text[: len(start) + len(put) + len(after[0])]
    return text, [(k, max(0, x), min(len(text), y)) for k, x, y in own if x < len(text)]


def train(docs: DataFrame, seed: int = 0) -> Tagger | None:
    """A network trained on passages of a bounded sample of `docs` (doc_id, text); none if there is no passage.

    Half of the passages hold spans of the patterns, as far as there are any. The network is trained in one task, from 2 * PASSAGES
    passages of PASSAGE characters at most, whatever the documents' number, length or ids; the driver gets its parameters alone.
    """
    hashed = docs.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h"))
    last = hashed.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]  # hashes alone are sorted, not texts
    sample = hashed.where(F.col("h") <= F.lit(last if last is not None else 0)).dropDuplicates(["h"]).select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                spans, taken = base_spans(text), set()
                for _, x, y in spans:
                    taken.add(max(0, min(x, (x + y - PASSAGE) // 2)))
                for at in range(0, len(text), 5 * PASSAGE):
                    taken.add(at)
                for at in sorted(taken):
                    own = [f"{k}:{x - at}:{y - at}" for k, x, y in spans if x >= at and y <= at + PASSAGE]
                    if not any(x < at + PASSAGE and at < y and not (x >= at and y <= at + PASSAGE) for _, x, y in spans):
                        rows.append((text[at : at + PASSAGE], ",".join(own)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["passage", "spans"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(p, s) for b in batches for p, s in zip(*[c.to_pylist() for c in b.columns], strict=True)})
        if rows:
            made = trained([(p, [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in spans.split(",") if s)]) for p, spans in rows], seed)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["tagger"])

    staged = Staged(docs.sparkSession, "pii")
    found = staged.put(sample.mapInArrow(cut, "passage string, spans string").where("trim(passage) <> ''").distinct())
    some, none = (found.where(w).orderBy(F.xxhash64("passage"), "passage").limit(PASSAGES) for w in ("spans <> ''", "spans = ''"))
    out = some.unionAll(none).coalesce(1).mapInArrow(learn, "tagger binary").collect()  # one row, as large for any corpus
    staged.drop(found)
    return pickle.loads(out[0].tagger) if out else None


def trained(rows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 0) -> Tagger:
    r = np.random.default_rng(seed)
    words = sorted({w for p, _ in rows for w in re.findall(r"[^\W\d_]{2,12}", p)}) or ["name"]
    made = [*rows, *[example(r, *rows[i], words) for i in r.integers(0, len(rows), max(0, EXAMPLES - len(rows)))]]
    x, y = np.zeros((len(made), PASSAGE), np.uint8), np.zeros((len(made), PASSAGE), np.int8)
    for i, (passage, own) in enumerate(made):
        x[i, : len(passage)] = symbols(passage)
        y[i] = label_row(PASSAGE, own)
    tagger = Tagger(seed=seed)
    tagger.train(x, y, EPOCHS, seed=seed)
    return tagger


def _varied(passage: str, spans: list, r: np.random.Generator) -> str:
    out = list(passage)
    for _, a, z in spans:
        for i in range(max(a, 0), min(z, len(out))):
            c = out[i]
            if "0" <= c <= "9":
                out[i] = str(r.integers(10))
            elif "a" <= c <= "z" and r.random() < 0.7:
                out[i] = chr(97 + r.integers(26))
    return "".join(out)


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, base, spans) for every row of `docs` (doc_id, text): comma-joined kind:start:end, code points, by start and kind.

    Null and empty texts have none. base has the patterns' spans alone, spans all; without a tagger both are the same.
    Texts of any length are read whole, and a task holds a text's characters, and scores where spans may lie. Rows that repeat, and
    rows without doc_id, come out as often as they come in; an empty table gives an empty result; other columns are ignored,
    whatever their names. Spans that begin at one place go by kind, in the order of KINDS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # as large for any corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = all_spans(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([_joined(f[i]) for f in found], pa.string()) for i in (0, 1)]], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base string, spans string")


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """`docs` with each span, or run of overlapping ones, replaced by its first's kind in brackets; n_chars, if there, is counted anew.

    What the patterns find only when something beside it is gone (of two card numbers in a row, which are no match together, the other one) is replaced as well.

    Every row comes out once, with all of its columns; null and empty texts stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def clean(text: str, spans: list) -> str:
        out, done = [], 0
        for kind, a, z in spans:
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, z)
        new = "".join([*out, text[done:]])
        bare = base_spans(new)  # fewer digits or at-signs each time
        return clean(new, bare) if bare else new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            new = [clean(t, f[1]) if f[1] else t for t, f in zip(texts, all_spans(shared.value, texts), strict=True)]
            cols = [pa.array(new, pa.string()) if name == "text" else c for name, c in zip(b.schema.names, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
