"""Every query of the training-data operators, over whole small tables, against SQL or another implementation."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from loomcast.llm import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return out


@pytest.fixture(scope="module")
def texts(db):
    return {k: t or "" for k, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return queries.queries()[name](spark, SMALL).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, db, name):
    said = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in said.description]
    found = rows(spark, name)
    assert sorted(found[0].asDict()) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == sorted(said.fetchall(), key=repr)


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    t, pieces, sequences = Tokenizer.from_file(P.path("byte_bpe_50k.json")), collections.defaultdict(list), collections.defaultdict(list)
    t.encode_special_tokens = True
    for r in rows(spark, "op1_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for k, some in pieces.items():
        ids = np.array([*t.encode(texts[k], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(some, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding, groups = 0, collections.defaultdict(collections.Counter)
    for k, some in sequences.items():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        groups[some[0].tier, some[0].step_group][k] = sum(r.length**2 for r in some)
    assert padding == 0
    # A step group has sequences of one tier, of 32,768 tokens at most.
    assert all(tier * len(g) <= 32_768 for (tier, _), g in groups.items())


def test_op4(spark, db, texts):
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = rows(spark, "op4_language")
    assert {r.doc_id for r in found} == texts.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
    judged = [r for r in found if r.held_out and r.lang_pred != "und" and lang[r.doc_id] is not None]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.95 * len(judged) > 10


def test_op7(spark, texts):
    import xxhash

    prints = {}
    for k, t in texts.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op7_simhash")}
    assert found == {k: (f"{prints[k]:016x}", find(k)) for k in ids}


def test_op8(spark, texts):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in rows(spark, "op8_bpe")}
    assert found.keys() == texts.keys()
    for k, t in texts.items():
        ids = library.encode_ordinary(t)
        assert (found[k].n_tokens, found[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert found[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_op9(spark, texts):
    from loomcast.llm import mpeg

    by_text = collections.defaultdict(set)
    for r in rows(spark, "op9_mpeg"):
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = mpeg.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature.endswith("ok=1")
        by_text[texts[r.doc_id]].add((r.media_sha256, r.feature))
    assert by_text.keys() == set(texts.values()) and all(len(x) == 1 for x in by_text.values())


def test_op10(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    at, found = 0, sorted(rows(spark, "op10_records"), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(texts)
    for r in found:
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
