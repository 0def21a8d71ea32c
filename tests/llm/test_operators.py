"""The training-data operators against brute force, the libraries they stand for, or a round trip."""

import base64
import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from loomcast.llm import bpe, embeddings, graph, langid, lines, mpeg, near_documents, packing, records, shared, simhash, substrings, warc  # noqa: E402
from loomcast.llm.queries import BYTE_BPE, MULTI_BPE, WORD_BPE  # noqa: E402

PARTS = ["the", "of", "and", "é", "ß", "中文", " ", "  ", "\n", " \n ", "'s", "12", "!!", "😀", "\x1c", "İ", "<|endoftext|>", "\t", "a" * 400, " ", "é"]


def texts(n=60, seed=1):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "word", "a " * 3000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["one two three"] * 3


SCHEMA = "doc_id long, text string, lang string, ids string, `a.b` string"


def table(spark, rows):
    """Documents with columns whose names clash with the operators' own; a null id, and an id twice."""
    data = [(k, t, "en", "clash", "dot") for k, t in enumerate(rows)] + [(None, "null id", None, "c", "d"), (1, "again", "en", "c", "d")]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def prose(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdnrst") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    return lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)), rng


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = texts()
    found = packing.pack(table(spark, rows), BYTE_BPE, context=64, window_tokens=500).collect()
    t = Tokenizer.from_file(BYTE_BPE)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        if r.doc_id not in (None, 1):
            by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, text in enumerate(rows):
        if k == 1:
            continue
        pieces = sorted(by_doc[k], key=lambda r: r.start)
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == ids and {r.doc_tokens for r in pieces} == {len(ids)}
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        total = sum(r.length for r in s)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist()
        assert total <= 64 and total & (total - 1) == 0 and total == s[0].tier
    assert not packing.pack(table(spark, rows).where("false"), BYTE_BPE).collect()


def test_library_ids(spark):
    from tokenizers import Tokenizer

    from loomcast.llm.tokenizers_lib import LibraryEncoder

    rows = [t or "" for t in texts(2000)]
    for path in (BYTE_BPE, WORD_BPE):
        expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in LibraryEncoder(path).encode(rows)] == expected


def test_a_small_word_cache_changes_no_id_and_stays_small(spark):
    from loomcast.llm.tokenizers_lib import LibraryEncoder

    make, _ = prose(0)
    rows = [make(400) for _ in range(30)]
    for path in (BYTE_BPE, WORD_BPE):
        large, small = LibraryEncoder(path), LibraryEncoder(path, limit=100)
        for t in rows:  # at most one text's words are beyond the limit
            assert small.encode([t]) == large.encode([t])
            assert len(small.cache.tails) <= 100 + 400 and len(small.cache.heads) <= 100 and len(small.cache.words) <= 200 + 400
        assert len(large.cache.tails) > 1000
        small.forget()
        assert max(map(len, (small.cache.words, small.cache.heads, small.cache.tails))) <= 20
    docs = table(spark, texts() + rows)
    packed = [packing.pack(docs, BYTE_BPE, context=64, window_tokens=500, **cache).collect() for cache in ({}, {"cache_limit": 10})]
    assert packed[0] == packed[1]


def anonymous_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_tasks_give_back_what_their_batches_had():
    def run(batches):
        for batch in batches:
            yield batch

    made = (pa.record_batch([pa.array([b"x" * (1 << 16)])], names=["a"]) for _ in range(1))
    before = anonymous_mb()
    held = [pa.array([b"x" * (1 << 16)]) for _ in range(2048)]
    full = anonymous_mb()
    assert full > before + 100
    del held
    assert sum(len(b) for b in shared.giving_back(run)(made)) == 1
    assert anonymous_mb() < before + 40


def test_bpe(spark):
    import tiktoken

    rows = texts(300)
    with open(MULTI_BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(table(spark, rows), MULTI_BPE, P.PATTERN), MULTI_BPE)
    both = bpe.round_trip(table(spark, rows), MULTI_BPE, P.PATTERN)
    assert found.columns == both.columns == ["doc_id", "text", "lang", "a.b", "ids", "decoded"]
    assert not bpe.round_trip(table(spark, rows).where("false"), MULTI_BPE, P.PATTERN).collect()
    for r in [*found.collect(), *both.collect()]:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_bpe_of_long_words():
    import tiktoken

    coder, rng = bpe.Encoder(MULTI_BPE, P.PATTERN), random.Random(8)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for letters in ("a", "ab", "acgt", "éèàß", "中文字漢語日本", "etaoinshrdlu"):
        for n in (257, 500, 3000):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert np.frombuffer(coder.encode_words([word])[0], "<u4").tolist() == library.encode_ordinary(word)
    word = "ab" * 50_000
    assert np.frombuffer(coder.encode_words([word])[0], "<u4").tolist() == library.encode_ordinary(word)
    # A vocabulary may not hold to what pieces rely on; the queries themselves are bounded anyhow.
    word = ("the" * 700).encode()
    assert np.frombuffer(coder._contract([word])[0], "<u4").tolist() == library.encode_ordinary(word.decode())


def test_records(spark):
    from tokenizers import Tokenizer

    rows = texts()
    manifest = records.write_records(table(spark, rows), WORD_BPE, shard_bytes=2000)
    assert manifest.count() > 1
    found = sorted(records.read_records(manifest, records_at_once=3).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == len(rows) + 2
    assert [r.start for r in found] == np.cumsum([0, *[len(r.ids) // 4 for r in found]])[:-1].tolist()
    t = Tokenizer.from_file(WORD_BPE)
    for r in found:
        if r.doc_id not in (None, 1):
            assert np.frombuffer(r.ids, "<u4").tolist() == [*t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 2]
    shuffled = records.read_shuffled(manifest, seed=3, records_at_once=2).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in shuffled) == sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in found)
    by_shard = collections.defaultdict(list)
    for r in shuffled:
        by_shard[r.shard].append(r.record)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and any(x != sorted(x) for x in by_shard.values())
    empty = records.write_records(table(spark, rows).where("false"), WORD_BPE)
    assert not records.read_records(empty).collect() and not records.read_shuffled(empty).collect()


def test_record_checksums():
    assert records.crc32c_many([b"123456789", b""]).tolist() == [0xE3069283, 0]  # the check value of CRC-32C
    raw = b"".join(records.framed([b"x" * k for k in (0, 3, 500)]))
    assert [len(d) for d in records.unframed(raw)] == [0, 3, 500]
    for damaged in (raw[:-1], raw[:20] + b"?" + raw[21:]):
        with pytest.raises(ValueError):
            records.unframed(damaged)


def test_mpeg(spark):
    rows = [*texts(), "\x00\xff" * 3000]
    for r in mpeg.read_media(mpeg.write_media(table(spark, rows))).collect():
        raw = (r.text or "").encode()
        assert bytes(r.audio.payload) == raw + bytes(-len(raw) % 64 or (0 if raw else 64)) and r.audio.whole
        assert r.audio.samples == 1152 * r.audio.frames and len(r.audio.seek_offsets) == r.audio.frames
    media = mpeg.encode(b"\xff\xfa" * 4000 + bytes(64))
    hurt = mpeg.decode(media[:900] + b"???" + media[900:])
    assert hurt.damaged and not hurt.whole and 0 < hurt.frames
    assert mpeg.decode(media).whole and not mpeg.decode(b"").whole


def test_mpeg_damage_is_never_an_error():
    media, rng = mpeg.encode(mpeg.padded(b"some text" * 300)), random.Random(1)
    for _ in range(300):
        raw = bytearray(media)
        for _ in range(rng.randint(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        del raw[rng.randrange(len(raw)) :: rng.choice([10_000, 700])]
        mpeg.decode(bytes(raw))
        mpeg.decode(bytes(raw[: rng.randrange(len(raw))]))
    for value in (b"payload=\xb2;crc32=zz", b"payload=;crc32=", b"payload=9999999999999999999999"):
        body = b"\0" + mpeg.TAG_NAME + b"\0" + value
        tag = b"TXXX" + len(body).to_bytes(4, "big") + bytes(2) + body
        assert mpeg.decode(b"ID3\x03\0\0" + mpeg.synchsafe(len(tag)) + tag).tag_crc32 is None


def test_mpeg_tags_and_tables():
    def tag(version, flags, *frames):
        size = mpeg.synchsafe if version == 4 else lambda n: n.to_bytes(4, "big")
        body = b"".join(k + size(len(b)) + bytes(2) + b for k, b in frames) + bytes(20)
        return b"ID3" + bytes((version, 0, flags)) + mpeg.synchsafe(len(body)) + body

    for version in (3, 4):
        raw = tag(version, 0, (b"TIT2", b"\0title"), (b"APIC", b"x" * 200), (b"TXXX", b"\0" + mpeg.TAG_NAME + b"\0payload=5;crc32=0000000a"))
        length, frames, whole = mpeg.tag_frames(raw)
        assert (length, whole, [k for k, _ in frames]) == (len(raw), True, [b"TIT2", b"APIC", b"TXXX"]) and mpeg.own_tag(frames) == (5, 10)
    assert mpeg.tag_frames(tag(3, 0, (b"TIT2", b"x"))[:14])[2] is False
    side = 17
    assert mpeg.rate_table(bytes(side) + b"Info" + (3).to_bytes(4, "big") + (7).to_bytes(4, "big") + (900).to_bytes(4, "big"), side) == (7, 900)
    assert mpeg.rate_table(bytes(side) + b"Xing" + (2).to_bytes(4, "big") + (900).to_bytes(4, "big"), side) == (None, 900)
    assert mpeg.rate_table(bytes(side) + b"Xing" + (1).to_bytes(4, "big"), side) is None
    assert mpeg.rate_table(bytes(32) + b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes(4), side) == (7, 900)


def test_warc(spark):
    rows = [(0, "http://a\n", "same"), (1, None, "same"), (2, "u", None), (3, "u", ""), (None, "u", "same"), (5, "u", "other é"), (5, "u", "other é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    found = warc.read_archives(warc.write_archives(pages, archive_bytes=300), range_bytes=100).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found) == [(-1, "revisit", 0, 4), (0, "response", None, 4), (1, "revisit", 0, 4), (2, "response", None, 0), (3, "revisit", 2, 0), (5, "response", None, 8), (5, "response", None, 8)]
    assert {r.payload_digest for r in found if r.payload_bytes == 4} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert next(r.url for r in found if r.page_id == 0) == "http://a\n"
    assert not warc.read_archives(warc.write_archives(pages.where("false"))).collect()


def test_warc_repeated_ids(spark):
    rows = [(0, "a", "same"), (None, "b", "same"), (None, "c", "own"), (None, "d", "again"), (None, "e", "again"), (7, "f", "same"), (7, "g", "other"), (7, "h", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.url: (r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    again = {"b", "f", "h"}
    assert found == {url: (k, "revisit", 0, None) if url in again else (k, "response", None, html.encode()) for k, url, html in rows}


@pytest.mark.parametrize("zip64", [None, True])
def test_zip_directory(zip64, tmp_path):
    import zipfile

    raw = b"".join(warc.zip_chunks([("a/b", [b"xy", b"z"]), ("c", [])], zip64))
    members = warc.zip_members(lambda at, n: raw[at : at + n], len(raw))
    assert {k: raw[a : a + n] for k, (a, n) in members.items()} == {"a/b": b"xyz", "c": b""}
    (tmp_path / "z").write_bytes(raw)
    assert zipfile.ZipFile(tmp_path / "z").read("a/b") == b"xyz" and zlib.crc32(b"xyz")


def test_language(spark):
    rng = random.Random(5)
    words = {"xx": ["der", "und", "nicht", "für"], "yy": ["the", "and", "of", "with"], "zz": ["que", "los", "para", "ción"]}
    rows = [(k, " ".join(rng.choice(words[g]) for _ in range(20)), g) for k, g in enumerate(list(words) * 20)]
    rows += [(100, None, "xx"), (101, "123 !!", "yy"), (102, "", None), (103, "the and of", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, keep=F.col("doc_id") % 4 != 2)
    found = {r.doc_id: r for r in langid.identify(df, model).select("doc_id", "language.*").collect()}
    assert all(found[k].lang_pred == g for k, _, g in rows[:60]) and [found[k].lang_pred for k in (100, 101, 102, 103)] == ["und", "und", "und", "yy"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.identify(df, langid.train(df.where("false"))).select("language.lang_pred").distinct().collect()[0][0] == "und"
    for n in (2, 3, 5, 9, 30):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n and (np.abs(c.sum(0)) < n).all()


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("tile", [2048, 8])
def test_simhash(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    make, rng = prose(0)
    base = make(400).split()
    rows = [None, "", "!", "A b", "a B"] + [make(30) for _ in range(30)]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(400)] = "edit"
        rows.append(" ".join(words))
    found = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    fps = [int(simhash.fingerprint(t or "")[0][0]) for t in rows]
    expected = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert [found[k].component_id for k in range(len(rows))] == expected and [found[k].fp % (1 << 64) for k in range(len(rows))] == fps
    empty = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert not empty.collect()


@pytest.mark.parametrize("tile", [2048, 8])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 20))
    v = np.concatenate((v, v[:1] + 0.05 * rng.normal(size=(40, 20)), v[5:8], v[5:6] * 3))
    rows = [(k, x.tolist(), k % 2 if k < 10 else 0) for k, x in enumerate(v)]
    rows += [(200, None, 0), (201, [0.0] * 20, 0), (202, [float("nan")] * 20, 0), (203, [None] * 20, 0), (204, v[0].tolist(), None), (205, [], 0), (206, [1.0, 2.0], 0)]
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows[: len(v)]])[:, None] == np.array([r[2] for r in rows[: len(v)]])[None])
    np.fill_diagonal(near, False)
    expected = roots(len(v), zip(*np.nonzero(near), strict=True))
    assert [found[k].n_links for k in range(len(v))] == near.sum(1).tolist() and [found[k].component_id for k in range(len(v))] == expected
    assert all(found[k].n_links == 0 and found[k].kept for k in range(200, 207))


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    expected = roots(500, pairs)
    assert found == {x: expected[x] for p in pairs for x in p if p[0] != p[1]}


def brute_lines(rows, threshold=0.8):
    seen, gone = [], collections.defaultdict(list)
    for k, text in enumerate(rows):
        for n, line in enumerate((text or "").split("\n")):
            words = [w for w in line.replace("\t", " ").split(" ") if w]
            s = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None
            if s:
                if any(len(s & o) >= threshold * len(s | o) for o in seen):
                    gone[k].append(n)
                seen.append(s)
    return gone


def test_lines(spark):
    make, rng = prose(0)
    base = [make(60) for _ in range(6)]
    rows = [None, "", "\n\n", "x", "x\nx"]
    for _ in range(40):
        some = []
        for _ in range(4):
            words = rng.choice(base).split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(60)] = make(1)
            some.append(" ".join(words))
        rows.append("\n".join([*some, make(9), ""]))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("n", F.lit(1))
    expected = brute_lines(rows)
    assert {r.doc_id: r.removed for r in lines.removed_lines(df).collect()} == {k: expected.get(k, []) for k in range(len(rows))}
    for r in lines.dedup_lines(df).collect():
        assert r.text == (rows[r.doc_id] if r.doc_id not in expected else "\n".join(x for n, x in enumerate(rows[r.doc_id].split("\n")) if n not in expected[r.doc_id]))
    assert not lines.removed_lines(df.where("false")).collect()


def test_lines_of_rows_without_an_id_of_their_own(spark):
    make, _ = prose(0)
    twice, four, once = make(30), make(30), [make(30) for _ in range(8)]
    rows = [(None, f"{once[0]}\n{twice}"), (None, f"{once[1]}\n{twice}\n{once[2]}"), (None, None), (-5, f"{once[3]}\n{four}\n{once[4]}"), (-5, f"{once[5]}\n{four}\n{four}"), (8, f"{four}\n{once[6]}"), (None, f"{once[7]}\n{four}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lines.dedup_lines(df).collect()
    assert len(out) == len(rows) and sum(r.text is None for r in out) == 1
    assert sorted(x for r in out if r.text is not None for x in r.text.split("\n")) == sorted([*once, twice, four])
    assert {r.doc_id for r in out if r.text and four in r.text} == {-5}
    found = lines.removed_lines(df).collect()
    assert sorted((r.doc_id or 0, r.n_lines) for r in found) == sorted((k or 0, len((t or "").split("\n"))) for k, t in rows)
    assert sum(r.n_removed for r in found) == 5


def test_lines_are_hashed_in_compiled_code(spark):
    make, _ = prose(0)
    texts = ["", " ", *[make(n) for n in range(1, 14)], "a  a\ta a a a\ra ", "\u00e9 \u4e2d " * 9, make(300)]
    words = lines.with_words(spark.createDataFrame([(t,) for t in texts], "line string"))
    found = lines.with_hashes(words.withColumn("kept", F.col("words")), 5)
    found = found.withColumn("tokens", lines._by_rarity(bytes(k % 128 for k in range(lines.CELLS))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "mapobjects" in plan
    coded = F.transform("kept", lambda w: F.xxhash64(w))  # nulls beyond the end leave a hash as it is
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("kept") - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(coded, i + k) for k in range(5)]))
    for r in found.select("kept", "hashes", "tokens", runs.alias("expected")).collect():
        assert r.hashes == (r.expected if r.kept else [])
        assert r.tokens == sorted({((h & (lines.CELLS - 1)) % 128 << 56) | (h & ((1 << 56) - 1)) for h in r.hashes})


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 150)
    monkeypatch.setattr(substrings, "BYTES_AT_ONCE", 64)
    make, rng = prose(0)
    passage, vocabulary = make(25), ["a", "b"]
    rows = [None, "", "short text", " ".join(rng.choice(vocabulary) for _ in range(300)), "x" * 500]
    rows += [f"{make(rng.randrange(30))}\t{passage}\n {make(20)}" if rng.random() < 0.4 else make(40) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("given", F.lit("clash"))
    words = [(t or "").split() for t in rows]
    counts = collections.Counter(tuple(w[i : i + 10]) for w in words for i in range(len(w) - 9))
    for r in substrings.remove_repeats(df.repartition(3), window=10).collect():
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 9) if counts[tuple(w[i : i + 10])] > 1 for j in range(i, i + 10)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)) and r.given == "clash" and r.text == rows[r.doc_id]
        assert {j for a, b in r.removed for j in range(a, b)} == gone
    assert not substrings.remove_repeats(df.where("false")).collect()


def test_distinct_documents(spark):
    make, rng = prose(0)
    base = make(200).split()
    rows = [None, "", make(100), make(100)] + [" ".join(base)] * 2
    for n in (1, 2, 2, 3):
        words = list(base)
        for _ in range(n):
            words[rng.randrange(200)] = make(1)
        rows.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("row", F.lit(1))
    assert sorted(r.doc_id for r in near_documents.distinct_documents(df).collect()) == [0, 2, 3, 4]


def distinct_by_force(rows, similarity=0.8):
    """The first row of each group that pairs of the similarity make."""
    sets, root = [near_documents.shingle_set(t, 5) for t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if root[i] != root[j] and common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def test_distinct_documents_around_the_similarity(spark):
    make, rng = prose(0)
    rows = []
    for _ in range(2):
        base = make(204).split()
        for _ in range(120):
            words = list(base)
            for _ in range(rng.randrange(2, 7)):
                words[rng.randrange(204)] = make(1)
            rows.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_documents.distinct_documents(df).collect()) == distinct_by_force(rows)


@pytest.mark.parametrize("tile", [1024, 3])
def test_distinct_short_documents(spark, monkeypatch, tile):
    monkeypatch.setattr(near_documents, "SET_TILE", tile, raising=False)
    make, rng = prose(0)
    rows = []
    for n in [8] * 60 + [10, 16, 19, 30, 36, 37, 44] * 4:
        text = make(n)
        rows += [text, f"{text} {make(1)}", f"{make(1)} {text} {make(1)}"]
    stem = make(40)
    rows += [f"{stem} {make(rng.randrange(1, 5))}" for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_documents.distinct_documents(df).collect()) == distinct_by_force(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    make, _ = prose(0)
    common = make(60)
    rows = [(k, f"{make(80)}\n{common if k % 3 == 0 else make(60)}\n{make(50)}", "en", "s", 0) for k in range(20)]
    rows += [(50, rows[4][1], "en", "s", 0), (51, "123 456", "en", "s", 0), (52, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= set(range(20)) - {0} and not {51, 52} & {r.doc_id for r in out}


def test_lines_that_share_a_token_by_chance_take_no_token_sets(spark, monkeypatch):
    """Each line shares half of its shingles with the next and is similar to none; one near copy goes."""
    rows = {}
    keep = lines.written_in_parts

    def counted(parts, what):
        out = keep(parts, what)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(lines, "written_in_parts", counted)
    phrases = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(40)]
    texts = [f"{phrases[k]} {phrases[(k + 1) % 40]}" for k in range(40)]
    copy = texts[7] + " end"
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, copy])], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in lines.removed_lines(docs).collect()}
    assert found == {k: int(k == 40) for k in range(41)}
    assert rows["line-sets"] == 41 and rows["shared-postings"] > 0
    assert rows["whole-lines"] <= 4  # the copy and its first, once for each of the two rounds; before: all 41
