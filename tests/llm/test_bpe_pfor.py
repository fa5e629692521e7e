from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import cases
from tokenizers import Regex, Tokenizer, pre_tokenizers

from callgauge.llm import bpe, pfor, units

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
OURS = bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
with open(RANKS, "rb") as lines:
    THEIRS = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={}
    )
PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "’", "'s", "1", "２", "日本", "!", "#", "\U0001f600", "aaaa", "zq", "ing", "tion"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_ids_are_those_of_the_merges(text):
    ids = OURS.encode(text)
    assert ids.tolist() == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_long_pieces_and_forgetting():
    draw = random.Random(2)
    small = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    small.cached.limit = 3
    for text in ("a" * 4001, "".join(draw.choice("abcdefgh") for _ in range(5000)), "so so, then so, so. then"):
        assert small.encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_a_rank_file_without_a_byte_is_an_error(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(x).decode()} {k}\n" for k, x in enumerate([b"a", b"b", b"ab"])))
    with pytest.raises(ValueError):
        bpe.Bpe(str(path), r"\w+")


def test_encode_every_row(spark):
    found = bpe.encode(cases.clashing(spark), RANKS, public_tokenizers.PATTERN)
    expected = []
    for doc_id, text in cases.ROWS:
        ids = THEIRS.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert cases.rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=str)
    back = bpe.decode(found, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(text or "" for _, text in cases.ROWS)
    assert bpe.encode(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400), max_size=6), st.integers(1, 300), st.sampled_from([0.0, 0.5, 0.98, 1.0]))
def test_shards_round_trip(parts, length, share):
    arrays = [np.array(x, dtype=np.uint32) for x in parts]
    shard = pfor.open_shard(pfor.write_shard([None, *range(1, len(parts))][: len(parts)], arrays, length, share))
    whole = np.concatenate([np.zeros(0, np.uint32), *arrays])
    assert pfor.read_ids(shard).tolist() == whole.tolist()
    assert shard.sizes.tolist() == [len(x) for x in parts]
    assert shard.doc_ids == [None, *range(1, len(parts))][: len(parts)]
    for start in range(0, len(whole), max(1, len(whole) // 5)):
        assert pfor.read_ids(shard, start, start + 7).tolist() == whole[start : start + 7].tolist()


def test_outliers_cost_little():
    ids = np.array([5] * 127 + [2**31], dtype=np.uint32)
    assert len(pfor.write_shard([1], [ids])) < 100


def test_another_file_is_refused():
    with pytest.raises(ValueError):
        pfor.open_shard(b"x" * 100)


def test_written_shards_give_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pfor, "SHARD_IDS", 50)
    library = Tokenizer.from_file(JSON)
    for k, docs in enumerate((cases.clashing(spark), cases.empty(spark))):
        folder = str(tmp_path / str(k))
        pfor.write(docs, JSON, folder)
        start, expected = 0, []
        for doc_id, text in sorted(cases.ROWS if k == 0 else [], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
            ids = library.encode(text or "", add_special_tokens=False).ids + [0]
            expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert cases.rows_of(pfor.read(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)


def test_units_join_to_the_text():
    for text in ("a  b \n c ", " x", "", "a b", "  ", "q\x1c w"):
        assert " ".join(units.cut(text)) == text


@pytest.mark.parametrize("limit", [3, units.CACHE_UNITS])
def test_slices_are_encoded_as_their_texts(limit):
    library = Tokenizer.from_file(JSON)
    encoder = units.UnitEncoder(pfor.library(JSON).encode_many, limit)
    odd = ["", " ", "a  b ", "x\n\n y", " z", "<|endoftext|> a<|endoftext|>b", "é ü　 k   m \x1c", "a \x85b", "it's 5's 12 34\t q  \n", "naïve*** naïve,*** naïve?"]
    for texts in (odd, odd[::-1], ["the words *** of the words."] * 3, [""], []):
        ids, sizes = encoder.encode_all(pa.array(texts, pa.string()).slice(0))
        expected = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, expected)) and ids.tolist() == sum(expected, [])


def test_units_unseen_are_encoded_together():
    calls = []
    library = pfor.library(JSON)

    def encode_many(texts):
        calls.append(len(texts))
        return library.encode_many(texts)

    encoder = units.UnitEncoder(encode_many)
    calls.clear()
    texts = [f"word{n % 50} and more{n} of it" for n in range(400)]
    encoder.encode_all(pa.array(texts))
    assert len(calls) == 2  # all units, all heads; a call for each text before


def test_cached_units_are_the_texts_ids():
    """Units met before, new ones, marks after letters, long units and characters beyond ASCII,
    over slices between which the cache turns over."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encoder = pfor.Tokenizer.from_file(path), units.UnitEncoder(pfor.library(path).encode_many, limit=6)
    texts = ["the thing, the thing.", "", "x" * 90 + " thing, thing " + "x" * 90 + "!!", "d\u00fcng, 12 d\u00fcng!? \U0001f600 the", "two  spaces end ", "the"]
    for part in (texts, texts[::-1], texts[2:4]):
        ids, sizes = encoder.encode_all(pa.array(part))
        want = [plain.encode(text, add_special_tokens=False).ids for text in part]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for own in want for x in own]
        assert all(len(unit) <= units.CACHE_CHARS for unit in encoder.young)


def test_units_met_before_stay_out_of_python(monkeypatch):
    seen, strings = [], units._strings
    monkeypatch.setattr(units, "_strings", lambda column: seen.append(len(column)) or strings(column))
    encoder = units.UnitEncoder(pfor.library(JSON).encode_many)
    texts = pa.array([f"word{n} and, more{n}.\nSo it, went{n}" for n in range(400)])
    first = encoder.encode_all(texts)
    seen.clear()
    again = encoder.encode_all(texts)
    assert sum(seen) < 410  # heads and runs of marks; all distinct units before
    assert all(np.array_equal(a, b) for a, b in zip(first, again))


def test_a_line_end_cuts_what_is_kept():
    encoder = units.UnitEncoder(pfor.library(JSON).encode_many, line_ends=pfor.library(JSON).line_ends)
    encoder.encode_all(pa.array(["The one.\nThe two,\nthe end", "The\n\nsame \n\x85\nlines"]))
    kept = [unit for page in encoder.pages for unit in page.units.to_pylist()]
    assert {"one", "\nThe", "two", "\nthe", "end"} <= set(kept) and "one.\nThe" not in kept


@pytest.mark.parametrize("limit", [2, 20, units.CACHE_UNITS])
def test_kept_pages_give_the_librarys_ids(limit):
    library, draw = Tokenizer.from_file(JSON), random.Random(limit)
    encoder = units.UnitEncoder(pfor.library(JSON).encode_many, limit, line_ends=True)
    parts = [*PARTS, "\n", ".\nThe ", "\nThe", " of.\n", " the", "\n\n", "　", "  ", "<|endoftext|>", ">", "x" * 70]
    for _ in range(60):
        texts = ["".join(draw.choices(parts, k=draw.randrange(40))) for _ in range(draw.choice([0, 1, 20]))]
        ids, sizes = encoder.encode_all(pa.array(["cut off", *texts], pa.string()).slice(1))
        want = [found.ids for found in library.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
        assert sum(len(page.units) for page in encoder.pages) <= 2 * limit
        assert all(len(unit) <= units.CACHE_CHARS for page in encoder.pages for unit in page.units.to_pylist())


def test_what_is_used_again_stays_kept():
    encoder = units.UnitEncoder(pfor.library(JSON).encode_many, limit=10)
    for n in range(30):
        encoder.encode_all(pa.array([f"a often w{n} x{n} y{n}"]))
    kept = [unit for page in encoder.pages for unit in page.units.to_pylist()]
    assert "often" in kept and "w0" not in kept


def test_a_pattern_that_takes_line_ends_along_keeps_them(tmp_path):
    tokenizer, path = Tokenizer.from_file(JSON), str(tmp_path / "own.json")
    pattern = Regex(r" ?[^\s\p{L}\p{N}]+[\r\n]*| ?\p{L}+| ?\p{N}+|\s+(?!\S)|\s+")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(pattern, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.save(path)
    texts = ["So it is;\n}\nand so", "{\n{ it.\nThe end"]
    ids, _ = pfor.library(path).encode_all(pa.array(texts))
    assert ids.tolist() == sum((x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)), [])
    assert pfor.library(JSON).line_ends and not pfor.library(path).line_ends
