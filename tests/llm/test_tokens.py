import io
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from kerbline.llm.packing import CapacityTree, first_fit_decreasing, pack_reports  # noqa: E402
from kerbline.llm.tokenfile import TokenFileReader, TokenFileWriter, read_token_files, write_token_files  # noqa: E402
from kerbline.llm.tokens import TextEncoder  # noqa: E402
from tests.llm.helpers import no_reports, odd_reports  # noqa: E402

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "  ", "a  b", "tail ", " head", "it's  don't 'll x' s", "a\nb\n\nc \n d", "a<|endoftext|>b <|endoftext|> <|", "é e ́ x",
    "12 3,4.5abc _x_ -", "\ttab x", "İstanbul ÀÉ ǅ ß ſ", "日本 語 テスト", "word.\nNext, line.\n\nTwo.", "x\u00a0 y z\u2003 w", "a.\n'tis b. ' c",
]


def plain(name, texts):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    return [np.array(e.ids, "<u4").tobytes() for e in found]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_same_tokens_as_whole_texts(spark, sf_dir, name):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    encoder = TextEncoder(public_tokenizers.path(name), pieces=50, parts=50)
    assert encoder.encode(texts) == plain(name, texts)
    assert encoder.encode(texts[::-1]) == plain(name, texts[::-1])


@pytest.mark.parametrize("name", FILES)
def test_words_that_end_in_a_combining_mark_once_normalised(name):
    words = ["\u0924\u0930\u095e", "AL\u0130", "\u05d0\ufb2a", "\u0130", "\ufb2a", "Stra\u00dfe", "e\u0301"]
    texts = [f"x {w}{m} y" for w in words for m in (",", ".", "?!", "")] + [f"x {a}.\n{b}, y" for a in words for b in words]
    assert TextEncoder(public_tokenizers.path(name)).encode(texts) == plain(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_drawn_texts_give_the_tokens_of_the_library(name):
    draw = random.Random(11)
    words = ["road", "Élan", "straße", "don't", "ÀÉ", "\u0130x", "e\u0301", "12", "a1b", "naïve", "\u0924\u0930\u095e", "日本", "x" * 400, "Œuvre", "ﬁn", "µ", "ª", "\x00", "a\x00b", "<|endoftext|>", "</w>", "Ġ"]
    marks = ["", "", "", ".", ",", "?!", "-", "...", "'", "'s", "\u0301", ")", "_", "\n", ".\n", "\n\n", "\t"]
    gaps = [" ", " ", " ", "  ", "\n", "", "\u00a0", " \n"]
    texts = ["".join(draw.choice(words) + draw.choice(marks) + draw.choice(gaps) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    encoder = TextEncoder(public_tokenizers.path(name))
    for begin in range(0, len(texts), 500):
        assert encoder.encode(texts[begin : begin + 500]) == plain(name, texts[begin : begin + 500])


def test_token_files_round_trip(spark):
    given = odd_reports(spark, [(100 + i, f"report {i} " * (i + 1)) for i in range(60)])
    path = public_tokenizers.path(FILES[0])
    for size in (1 << 30, 20_000):
        manifest = write_token_files(given, path, file_bytes=size)
        back = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
        rows = sorted(given.collect(), key=lambda r: (r.event_id is not None, r.event_id, r.report or ""))
        assert [r.event_id for r in back] == [r.event_id for r in rows]
        start = 0
        for r, ids in zip(back, plain(FILES[0], [r.report or "" for r in rows]), strict=True):
            ids += bytes(4)
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
            start += len(ids) // 4
    assert manifest.count() > 1
    assert read_token_files(write_token_files(no_reports(spark), path)).count() == 0


class Source(io.BytesIO):
    reads = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        self.reads += n
        return super().read(n)


def test_reader_opens_one_frame_and_finds_damage():
    sink, rng = io.BytesIO(), np.random.default_rng(0)
    writer, documents = TokenFileWriter(sink, frame_ids=1000), [rng.integers(0, 50_000, n, np.uint32).tobytes() for n in (3, 0, 900, 5000, 40, 1, 2000, 0)]
    for i, ids in enumerate(documents):
        writer.add(i, ids)
    writer.finish()
    source = Source(sink.getvalue())
    reader = TokenFileReader(source)
    assert reader.sizes.tolist() == [4 * 5903, 4 * 2041]
    assert [reader.document(i) for i in range(8)] == documents
    source.reads = 0
    reader.document(5)
    assert source.reads < source.size() / 2
    assert [d for _, _, d in reader.documents()] == documents
    damaged = bytearray(sink.getvalue())
    damaged[40] ^= 1
    with pytest.raises(Exception):
        list(TokenFileReader(Source(bytes(damaged))).documents())


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(1).integers(1, 2049, 500)
    bins, offsets = first_fit_decreasing(sizes, 2048)
    room, want = [2048] * 500, {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next(b for b in range(500) if room[b] >= sizes[i])
        want[i] = (b, 2048 - room[b])
        room[b] -= sizes[i]
    assert all((bins[i], offsets[i]) == want[i] for i in want)
    with pytest.raises(ValueError):
        CapacityTree(1, 5).take(6)


def test_packing_keeps_every_identifier_once(spark):
    given = odd_reports(spark, [(100 + i, f"report {i} " * (7 * i + 1)) for i in range(80)])
    path = public_tokenizers.path(FILES[1])
    rows = pack_reports(given, path, group_pieces=20, sequence=256).collect()
    ids = {(r.event_id, r.report): p + np.array([1], "<u4").tobytes() for r, p in zip(given.collect(), plain(FILES[1], [r.report or "" for r in given.collect()]), strict=True)}
    assert sum(r.length for r in rows) == sum(len(ids[(r.event_id, r.report)]) // 4 for r in given.collect())
    pieces = {(k, s // 4, zlib.crc32(v[s : s + 1024])) for (k, _), v in ids.items() for s in range(0, len(v), 1024)}
    assert {(r.event_id, r.start, r.ids_crc32) for r in rows} == pieces
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 256
    assert pack_reports(no_reports(spark), path).count() == 0
