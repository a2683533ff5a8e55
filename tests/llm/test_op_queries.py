"""Every opN query itself, on the smallest tables: the contract's columns, and its rows against SQL or plain code."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quire.llm import pii, queries as Q

DATA = os.environ.get("QUIRE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "op1_pack": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op7_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op8_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_whiten": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_passages": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op13_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.fixture(scope="module")
def rows(spark):
    """The rows of a query, made once."""
    made = {}

    def get(name):
        if name not in made:
            df = Q.QUERIES[name](spark, DATA)
            assert dict(x.split() for x in COLUMNS[name].split(", ")).items() <= dict(df.dtypes).items()
            made[name] = df.collect()
        return made[name]

    return get


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows_as_sql(rows, duck, name):
    want = duck.sql(Q.ORACLES[name])
    got = rows(name)
    shown = lambda xs: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in x]) for x in xs)
    names = sorted(want.columns)
    assert shown([r[c] for c in names] for r in got) == shown([x[want.columns.index(c)] for c in names] for x in want.fetchall()) and got


@pytest.mark.parametrize(("name", "modulus", "rest"), [("op2_toxicity", 4, 2), ("op10_language", 3, 1)])
def test_held_out(rows, documents, name, modulus, rest):
    got = rows(name)
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) and 0 <= r.score <= 1 for r in got)


def test_toxic_documents(rows, duck):
    got = {r.doc_id: r for r in rows("op2_toxicity")}
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    known = duck.sql("SELECT doc_id, toxic FROM labels").fetchall()
    assert sum(got[i].predicted == t for i, t in known if i in got) > 0.85 * sum(i in got for i, _ in known)  # few labels here


def test_languages(rows, documents):
    got, langs = {r.doc_id: r for r in rows("op10_language")}, {d[2] for d in documents if d[2]}
    assert all(got[i].lang_pred in langs if any(map(str.isalpha, t or "")) else (got[i].lang_pred, got[i].score) == ("und", 0.0) for i, t, *_ in documents)
    held = [(got[i].lang_pred, lang) for i, t, lang, _ in documents if lang and got[i].held_out and got[i].lang_pred != "und"]
    assert sum(a == b for a, b in held) > 0.9 * len(held)


def test_pieces_hold_each_id_once(rows, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in documents}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows("op1_pack"):
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length == len(part) and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids[i])
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_shards(rows, documents):
    got = rows("op5_kd_shards")
    size = lambda t: len((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in documents)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    together = defaultdict(set)
    for r in got:
        if not r.parted:
            together[r["size"], r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in together.values())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, text):
    d = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_personal_data(rows, documents):
    got = {r.doc_id: r for r in rows("op7_pii")}
    for i, t, *_ in documents:
        base = sorted((m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m[0]))
        shown = [f"{k}:{a}:{z}" for a, _, z, k in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(b[3] == k for b in base) for k in PATTERNS]
        every = [x.split(":") for x in got[i].spans.split(",") if x]
        assert set(shown) <= {":".join(x) for x in every}
        place = [(int(a), pii.KINDS.index(k)) for k, a, _ in every]
        assert place == sorted(place)


def test_fingerprints_and_components(rows, documents):
    got = {r.doc_id: r for r in rows("op9_simhash")}
    fps = {}
    for i, t, *_ in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i].fingerprint == f"{fps[i]:016x}"
    low = {i: i for i in fps}
    near = {i: [j for j, g in fps.items() if (f ^ g).bit_count() <= 3] for i, f in fps.items()}
    while True:
        new = {i: min(low[j] for j in near[i]) for i in low}
        if new == low:
            break
        low = new
    assert {i: r.component_id for i, r in got.items()} == low


def test_whitened_vectors(rows, duck):
    """Against exact integer covariances, one product at a time."""
    vectors = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    made = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({x for _, x in made})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = {x: [n * a - s for a, s in zip(x, sums, strict=True)] for x in fit}
    exact = np.array(list(y.values()), object)
    cov = (exact.T @ exact).astype(float) / float(n) ** 3
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    got, signs = {(r.vec_id, r.component): r for r in rows("op11_whiten")}, {}
    assert len(got) == 16 * len(made) and len({r.identity_error for r in got.values()}) == 1 and got[made[0][0], 1].identity_error < 1e-9
    for i, x in made:
        whitened = np.array([c / n for c in y[x]]) @ v / np.sqrt(e)
        for k in range(16):
            r = got[i, k + 1]
            sign = signs.setdefault(k, 1 if r.whitened * whitened[k] > 0 else -1)
            assert (r.n, r.deviation) == (n, sum(c * c for c in y[x])) and abs(r.whitened - sign * whitened[k]) < 1e-6 and abs(r.explained / (e[k] / np.trace(cov)) - 1) < 1e-9
