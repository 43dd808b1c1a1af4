"""Operators that write files and read them back: media, token store, WARC, packing."""

import base64
import dataclasses
import hashlib
import io
import tarfile
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import common, media, packing, tokenstore, warc
from millrace.llm.common import coalesced, filesystem
from millrace.llm.queries import word_tokenizer
from millrace.llm.tokens import Encoder


def ids_of(text):
    return [*Tokenizer.from_file(word_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


# --- media


def test_media_round_trip(messy):
    got = media.with_features(media.with_headers(media.in_shard_order(media.stored(messy)))).collect()
    want = Counter()
    for r in messy.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[(r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), 64, len(payload) // 64)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.width, r.height) for r in got) == want
    by_payload = defaultdict(set)
    for r in got:
        by_payload[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
        assert r.payload_sha256 == r.digest
    assert all(len(v) == 1 for v in by_payload.values())


def test_shards_are_plain_tar_files_of_png_members(messy):
    ledger = media.stored(messy).collect()
    for shard in {r.shard for r in ledger}:
        fs, path = filesystem(shard)
        with fs.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            names = [m.name for m in tar]
            assert len(names) == len(set(names))
            assert {n.removesuffix(".png") for n in names} == {r.digest for r in ledger if r.shard == shard}


def test_media_of_nothing(nothing):
    assert media.with_features(media.with_headers(media.in_shard_order(media.stored(nothing)))).count() == 0


@given(st.binary(max_size=400))
def test_png_is_lossless(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and media.samples(media.png(payload)).tobytes() == payload
    assert media.header(media.png(payload)[: media.HEADER])[:3] == (64, len(payload) // 64, 8)


# --- tokens


PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", *"ab.,;'s_ \n\t\0\x1féßİΣ́²ª1!A\xa0"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=4))
def test_memo_gives_the_ids_of_the_library(texts):
    e = ENCODER
    e.checked, e.by_word = 10**9, True
    assert [x.tolist() for x in e.encode(texts)] == [x.tolist() for x in e._whole(texts)]


ENCODER = Encoder(word_tokenizer(), memo=64)


def test_small_memo_empties_and_stays_right():
    texts = [" ".join(f"w{i}x{j}" for i in range(50)) for j in range(20)] + ["." * 50, "a.b, c. d"]
    ENCODER.by_word = True
    assert [x.tolist() for x in ENCODER.encode(texts)] == [x.tolist() for x in ENCODER._whole(texts)]


# --- packing


def test_packing_covers_every_id_once(messy):
    got = packing.packed(messy, word_tokenizer(), group=8).collect()
    texts = Counter((r.doc_id, r.text or "") for r in messy.select("doc_id", "text").collect())
    want = Counter()
    for (key, text), n in texts.items():
        ids = ids_of(text)
        for s in range(0, len(ids), 2048):
            want[(key, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048]), len(ids))] += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_nothing(nothing):
    assert packing.packed(nothing, word_tokenizer()).count() == 0


@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing_equals_the_plain_search(sizes):
    bins, offsets = packing.first_fit_decreasing(sizes, 20)
    free, want = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(20)
        want[i] = (b, 20 - free[b])
        free[b] -= sizes[i]
    assert list(zip(bins, offsets, strict=True)) == want


# --- token store


def test_store_round_trip(messy):
    store = tokenstore.write(messy, word_tokenizer())
    got = sorted(map(tuple, tokenstore.read(store).collect()), key=lambda r: r[1])
    docs = [(r.doc_id, ids_of(r.text)) for r in messy.select("doc_id", "text").collect()]
    want = Counter((k, len(i), crc(i)) for k, i in docs)
    assert Counter((k, n, c) for k, _, n, c in got) == want
    at = 0
    for key, start, n, _ in got:
        assert start == at
        at += n
    keys = [k for k, *_ in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    index = store.index.collect()
    assert len({bytes(r.digest) for r in index}) == len(index)
    distinct = {i[a:b].tobytes() for _, ids in docs for i in [np.array(ids, "<u2")] for a, b in zip([0, *tokenstore.cuts(i)], tokenstore.cuts(i), strict=False)}
    assert len(index) == len(distinct) and sum(r.n for r in index) == sum(len(d) // 2 for d in distinct)
    assert tokenstore.manifest_root(store.manifest.repartition(3)) == (store.root, store.documents) and store.documents == len(docs)
    back = tokenstore.documents(store).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in back) == Counter((k, tuple(i)) for k, i in docs)
    some = tokenstore.documents(store, messy.where("doc_id = 2").select("doc_id")).collect()
    assert Counter(tuple(r.ids) for r in some) == Counter(tuple(i) for k, i in docs if k == 2)


def test_damage_is_found(messy):
    store = tokenstore.write(messy.limit(5), word_tokenizer())
    pack = store.index.first().pack
    fs, path = filesystem(pack)
    with fs.open_input_file(path) as f:
        data = bytearray(f.read())
    data[3] ^= 1
    with fs.open_output_stream(path) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="damaged chunk"):
        tokenstore.read(store).collect()


def test_missing_parts_are_found(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(3)], "doc_id long, text string")
    store = tokenstore.write(docs, word_tokenizer())
    gone = store.index.first().digest
    less = dataclasses.replace(store, index=store.index.where(F.col("digest") != F.lit(gone)))
    for read in (tokenstore.read, tokenstore.documents):
        with pytest.raises(Exception, match="missing chunk"):
            read(less).collect()
        with pytest.raises(ValueError, match="manifest differs"):
            read(dataclasses.replace(store, manifest=store.manifest.where("doc_id <> 1")))


def test_work_tables_are_removed(messy, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    store = tokenstore.write(messy, word_tokenizer())
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["manifest", "store", "store-index"]
    assert tokenstore.read(store).count() == messy.count()


def test_staged_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    made = common.staged(spark.range(1000).repartition(3, F.col("id") % 7).groupBy("id").count(), "freed")
    ends = time.monotonic() + 10
    while (left := shuffles() - before) and time.monotonic() < ends:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert made.count() == 1000


def test_store_of_nothing(nothing):
    assert tokenstore.read(tokenstore.write(nothing, word_tokenizer())).count() == 0


@given(st.lists(st.integers(0, 3), max_size=3000))
def test_cuts_keep_their_bounds(ids):
    a = np.array(ids, np.uint16)
    ends = tokenstore.cuts(a, 8, 16, 64)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and (sizes <= 64 + 8).all() and (sizes[:-1] >= 8).all()


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_checksums_join(a, b):
    assert tokenstore.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_merkle_roots_depend_on_order():
    a, b, c = (tokenstore.digest_of(x) for x in (b"a", b"b", b"c"))
    assert len({tokenstore.merkle_root(x) for x in ([a, b, c], [b, a, c], [a, b], [a], [])}) == 5


# --- WARC

PAGES = "page_id long, url string, html string, sha string, holder long"
HTML = [(1, "http://a/1", "<p>x"), (2, "http://a/2", "<p>x"), (3, None, "<p>x"), (4, "u\r\nv", None), (5, "http://e", ""), (6, "http://f", "é\r\n\r\n" * 50_000), (None, "http://n", "<p>x"), (None, "http://m", "own"), (7, "http://g", "rep"), (7, "http://g", "rep")]


@pytest.mark.parametrize("few", [50_000, 0])
def test_warc_round_trip(spark, monkeypatch, few):
    """Holders of repeated payloads go to every task, or payloads are joined by digest."""
    monkeypatch.setattr(warc, "sized", lambda df: common.sized(df, few))
    pages = spark.createDataFrame([(*r, "s", 9) for r in HTML], PAGES)
    index = warc.written(pages)
    got = warc.read(index).collect()
    groups = defaultdict(list)
    for key, _, html in HTML:
        groups[html or ""].append(key)
    want = Counter()
    for key, _, html in HTML:
        raw = (html or "").encode()
        known = [k for k in groups[html or ""] if k is not None]
        holder = max(known) if known else None
        first = key == holder
        want[(key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else holder)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read(index.where("page_id IN (3, 6)"), with_payload=True).collect()}
    assert payloads == {3: "<p>x", 6: HTML[5][2]}


def test_warc_of_nothing(spark):
    assert warc.read(warc.written(spark.createDataFrame([], PAGES))).count() == 0


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 10**6), st.integers(1, 10**5)), max_size=30))
def test_coalesced_reads_hold_every_range(ranges):
    seen = []
    for file, start, end, inside in coalesced(ranges):
        for i in inside:
            f, o, n = ranges[i]
            assert f == file and start <= o and o + n <= end
        seen += inside
    assert sorted(seen) == list(range(len(ranges)))
