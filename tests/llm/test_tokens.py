"""Encoding against the tiktoken and tokenizers libraries, round trips, packing, media."""

import base64
import hashlib
import json
import pickle
import zipfile
import zlib
from array import array
from collections import defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm.bpe import Codec, codec, decode_bpe, encode_bpe
from larkspur.llm.byte_level import ByteLevelEncoder
from larkspur.llm.chunks import OVERHEAD, ByteCache
from larkspur.llm import media
from larkspur.llm.media import MediaArchiveReader, features, from_wav, media_columns, read_archives, to_wav, write_archives
from larkspur.llm.packing import cut_documents, encoder, first_fit_decreasing, pack_documents

PATH, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="ab' \n.1é", max_size=60), max_size=6))
def test_encodings_equal_the_libraries(library, tokenizer, texts):
    ours = [array("I", x).tolist() for x in codec(PATH, P.PATTERN).encode_all(texts)]
    assert ours == [library.encode_ordinary(t) for t in texts]
    assert [array("I", x).tolist() for x in encoder(JSON).encode_all(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pre_token(library):
    for text in ("ab" * 20_000, "a" * 5000, "thand" * 3000 + " x"):
        assert array("I", codec(PATH, P.PATTERN).encode_all([text])[0]).tolist() == library.encode_ordinary(text)


def test_encode_then_decode(docs, no_docs, library):
    coded = decode_bpe(encode_bpe(docs.withColumnRenamed("n_chars", "ids"), PATH, P.PATTERN), PATH).collect()
    assert len(coded) == docs.count()
    for r in coded:
        assert array("I", r["ids"]).tolist() == library.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").encode()
    assert encode_bpe(no_docs, PATH, P.PATTERN).count() == 0


def test_encoding_and_decoding_in_one_pass(docs, spark):
    rows = docs.select("doc_id", "text")
    apart = decode_bpe(encode_bpe(rows, PATH, P.PATTERN), PATH, bytes_col="back")
    assert encode_bpe(rows, PATH, P.PATTERN, bytes_col="back").exceptAll(apart).count() == 0


def test_caches_stay_within_their_bytes(library):
    small = Codec(PATH, P.PATTERN)
    small.chunks, small.pieces = ByteCache(20_000), ByteCache(5_000)
    texts = [" ".join(f"w{k * j % 997}x{j % 89}" for j in range(400)) + "  end\n\nof it" for k in range(30)]
    for _ in range(3):
        assert [array("I", x).tolist() for x in small.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
        for cache in (small.chunks, small.pieces):
            sizes = [sum(OVERHEAD + 2 * len(k) + len(v or b"") for k, v in g.items()) for g in (cache.young, cache.old)]
            assert cache.held >= sizes[0] and max(sizes) <= cache.most // 2


def test_a_pattern_that_crosses_spaces_is_not_cut():
    import tiktoken

    crossing = r"[a-z]+ [a-z]+|\s+|\S"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    other = tiktoken.Encoding("other", pat_str=crossing, mergeable_ranks=ranks, special_tokens={})
    ours = Codec(PATH, crossing)
    assert codec(PATH, P.PATTERN).cut and not ours.cut
    for text in ("in the end of it all", "A b c", "of the. of the"):
        assert array("I", ours.encode_all([text])[0]).tolist() == other.encode_ordinary(text)


def test_packing_is_lossless(docs, no_docs, tokenizer):
    pieces = pack_documents(docs, JSON, with_ids=True, group_pieces=8).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] <= 1024 and zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for s in by_sequence.values():
        end = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end <= 1024
    for r in docs.filter("doc_id <> 3").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        joined = b"".join(p["ids"] for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]))
        assert array("I", joined).tolist() == ids
    assert sum(p["length"] for p in by_doc[3]) == 2 * by_doc[3][0]["doc_tokens"]
    assert pack_documents(no_docs, JSON).count() == 0


def test_each_different_match_is_merged_once():
    """Words that meet line ends and punctuation in ever new ways cost the library no more than the words."""
    own = ByteLevelEncoder(JSON)
    given, merge = [], own.merge
    own.merge = lambda words: given.extend(words.to_pylist()) or merge(words)
    words = ["stone", "river", "light", "cloud", "quiet", "house"]
    texts = [f"{a}.{b}\n{c},{d}" for a in words for b in words for c in words for d in words]
    for half in (texts[::2], texts[1::2]):
        own.encode_all(half)
    assert len(given) == len(set(given)) == len(words) + 3


def test_columns_equal_the_library(tokenizer):
    kinds = ["a", "s", "ll", "1", "²", "٣", ".", "'", "'s", "'ve", "é", "漢", "e\u0301", "😀", "<|endoftext|>", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x00", "\x85", "\xa0", "\u2003", "\u3000"]
    texts = [None, "", *(a + b + c for a in kinds for b in kinds for c in kinds), "ab" * 20_000]
    want = [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for most in (0, 3000, 1 << 25):  # bytes that are remembered
        own = ByteLevelEncoder(JSON, most)
        for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(5, 900), pa.array(texts[:0], pa.string()), pa.array([None, ""])):
            ids, stops = own.encode_column(column)
            at = texts.index(column[0].as_py()) if len(column) else 0
            assert ids.tobytes() == b"".join(want[at : at + len(column)]) and len(stops) == len(column)
            assert own.held() <= most


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_files_of_another_kind_are_left_to_the_library(tmp_path, change):
    from tokenizers import Tokenizer

    with open(JSON) as f:
        (tmp_path / "other.json").write_text(json.dumps(json.load(f) | change))
    path = str(tmp_path / "other.json")
    texts = ["In the End.\nOf it, all", "of The", " (of)", "", None]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [array("I", x).tolist() for x in ByteLevelEncoder(path).encode_all(texts)] == want


def test_packing_leaves_little_room(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used = pack_documents(df, JSON).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.count("*"), F.sum("n")).first()
    assert used[1] > 0.98 * 1024 * used[0]


def test_first_fit_decreasing_equals_the_plain_search():
    import random

    import numpy as np

    r = random.Random(1)
    for n in (0, 1, 2, 50, 300):
        lengths = np.array([r.choice([1024, r.randint(1, 1024)]) for _ in range(n)], np.int64)
        bins, offsets = first_fit_decreasing(lengths, 1024)
        room: list[int] = []
        for k in np.argsort(-lengths, kind="stable").tolist():
            at = next((b for b, free in enumerate(room) if free >= lengths[k]), len(room))
            room += [1024] * (at == len(room))
            assert (bins[k], offsets[k]) == (at, 1024 - room[at])
            room[at] -= lengths[k]


def test_pieces_without_packing(docs):
    assert cut_documents(docs, JSON).filter("length < 1").count() == 0


def test_features_of_known_samples():
    got = json.loads(features(bytes([128, 130, 126, 255] * 16)))
    assert got == {"seconds": 64 / 8000, "mean": 31.75, "power": round((4 + 4 + 127**2) / 4, 6), "crossings": 32, "peak": 127, "mode": -2}


def test_wav_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 3, b"x" * 64):
        true, samples = from_wav(to_wav(data))
        assert true == len(data) and samples[:true] == data and len(samples) % 64 == 0 and len(samples) >= 64


def test_media_columns(docs, no_docs):
    got = media_columns(docs).collect()
    want = []
    for r in docs.collect():
        data = (r["text"] or "").encode()
        data += bytes(-len(data) % 64 or (0 if data else 64))
        want.append((str(r["doc_id"]), len((r["text"] or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert media_columns(no_docs).count() == 0


@pytest.fixture
def archives(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/media"
    return folder, write_archives(docs, folder, archive_bytes=2000)


def test_ranges_cover_every_member_once(docs, spark, archives):
    folder, manifest = archives
    assert manifest.count() > 1
    for step in (100, 500, 1 << 20):
        names = [r["name"] for r in read_archives(spark, folder, manifest, range_bytes=step).select("name").collect()]
        assert len(names) == len(set(names)) == docs.count()


def reader_of(folder, manifest, **options):
    files = {r["f"].rsplit("/", 1)[1]: r["s"] for r in manifest.groupBy(F.input_file_name().alias("f")).agg(F.sum("size").alias("s")).collect()}
    return MediaArchiveReader({"folder": folder, "manifests": json.dumps(list(files.items())), **options})


def rows_of(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_a_damaged_member_is_a_row_with_its_error(docs, archives):
    folder, manifest = archives
    path = manifest.orderBy(F.desc("members")).first()["archive"]
    with zipfile.ZipFile(path) as z:
        info = z.infolist()[0]
    with open(path, "r+b") as f:
        f.seek(info.header_offset + 30 + len(info.filename) + info.compress_size // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 255]))
    rows = rows_of(reader_of(folder, manifest, tries="2"))
    assert len(rows) == docs.count()
    assert [r["name"] for r in rows if r["error"]] == [info.filename]
    assert all((r["media"] is None) == (r["error"] is not None) for r in rows)


def test_a_lost_directory_is_a_row_with_its_error(docs, archives):
    folder, manifest = archives
    first = manifest.orderBy("archive").first()
    with open(first["archive"], "r+b") as f:
        f.truncate(first["size"] - 10)
    rows = rows_of(reader_of(folder, manifest, tries="1"))
    assert [r["name"] for r in rows if r["error"]] == [None] and len(rows) == docs.count() - first["members"] + 1


def test_a_member_is_tried_again(docs, archives, monkeypatch):
    folder, manifest = archives
    plain, failed = media.member, set()

    def flaky(f, info):
        if info.filename not in failed:
            failed.add(info.filename)
            raise OSError("connection reset")
        return plain(f, info)

    monkeypatch.setattr(media, "member", flaky)
    rows = rows_of(reader_of(folder, manifest))
    assert len(rows) == len(failed) == docs.count() and not any(r["error"] for r in rows)


def test_a_pickled_reader_has_no_list(archives):
    reader = pickle.loads(pickle.dumps(reader_of(*archives)))
    assert reader.manifests == []


def test_ids_of_any_text(spark):
    ids = ["a/b", "", None, "x y+z%", "-", "=q", "é"]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in media_columns(df).collect()) == sorted(map(str, ids))
