from __future__ import annotations

import time
import re

import numpy as np
import pytest

from tests.llm.texts import documents, frame, sortable
from weft.llm.sentencepiece_codec import BLANK, Lanes, Pieces, StreamingViterbi, decode, encode, encode_block, encode_exactly, normalised, read_model, stream
from weft.llm.token_counts import RANKS, RUN, count_tokens, document_token_counts, encoded, encoding
from weft.llm import token_counts
from weft.session import use_checkpoints


@pytest.fixture(scope="module")
def pieces() -> Pieces:
    return Pieces(read_model())


def whole_search(pieces: Pieces, text: str) -> list[int]:
    """Viterbi over the whole text, with a dictionary of pieces."""
    known = {pieces.names[i]: i for i in range(len(pieces.names)) if pieces.kinds[i] in (1, 4)}
    score = {i: float(s) for i, s in zip(pieces.ids.tolist(), pieces.scores.tolist()) if i >= 0}
    best, back = [0.0], [(0, -1)]
    for end in range(1, len(text) + 1):
        options = [(best[s] + score[known[text[s:end]]], s, known[text[s:end]]) for s in range(max(0, end - pieces.longest), end) if text[s:end] in known]
        if text[end - 1] not in known:
            options.append((best[end - 1] + pieces.unknown_score, end - 1, pieces.unknown))
        top = max(options, key=lambda o: (o[0], -o[1]))
        best.append(top[0])
        back.append(top[1:])
    out, end = [], len(text)
    while end:
        start, i = back[end]
        out.append((i, text[start:end]))
        end = start
    return pieces.spelled(out[::-1])


SAMPLES = ["", "a", " ", "  two  blanks ", "Hello world, this is a test.", "日本語 テキスト", "line\nbreak\ttab\r\n", "😀 smile", "x" * 230, "ab" * 192, "naïve façade", "aaaaaaaaaaaa" * 40]


def test_all_ways_find_the_best_path(pieces):
    texts = SAMPLES + [r[1] or "" for r in documents()[:20]]
    ids, at = encode_block(pieces, texts)
    for i, text in enumerate(texts):
        expected = whole_search(pieces, normalised(text))
        assert ids[at[i] : at[i + 1]].tolist() == expected
        assert stream(pieces, normalised(text)) == expected


def test_the_stream_keeps_a_bounded_window(pieces):
    search = StreamingViterbi(pieces)
    out = [x for c in normalised("some words of a text and many more " * 60) for x in search.push(c)]
    assert out and search.held <= 4 * pieces.longest


def test_all_lanes_commit_on_convergence_within_a_window(pieces):
    """Every piece of every stretch comes from the windowed search, most of them before the stretch's end."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeginorstuü日😀"), int(n))) for n in rng.integers(1, 400, 60)]
    words = sorted({BLANK + w for w in words} | {"ab" * 9}, key=len)
    lengths = np.array([len(w) for w in words])
    codes = np.full((len(words), lengths.max()), 0xFFFF, dtype=np.uint16)
    for row, w in zip(codes, words):
        row[: len(w)] = pieces.letter[[ord(c) for c in w]]
    lanes = Lanes(pieces, codes, lengths)
    lane, begin, ids = lanes.run()
    for i, w in enumerate(words):
        spans = [*begin[lane == i].tolist(), len(w)]
        found = [(k, w[a:b]) for k, a, b in zip(ids[lane == i].tolist(), spans, spans[1:])]
        assert pieces.spelled(found) == whole_search(pieces, w)
    assert lanes.early > 0.9 * lengths.sum() and lanes.widest <= 8 * pieces.longest


def test_blocks_of_many_long_stretches(pieces):
    texts = ["".join(chr(97 + (i * j + j * j // 7) % 5) for j in range(250 + i)) for i in range(20)]
    texts += [c * (200 + 9 * i) for i, c in enumerate("a=-.xo")]  # paths of all phases live on, so the ring grows
    ids, at = encode_block(pieces, texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole_search(pieces, normalised(t)) for t in texts]


def test_round_trips(pieces):
    ids, at, same = encode_exactly(pieces, [*SAMPLES, "a▁b"])
    assert same[:-1].all() and not same[-1]
    assert encode_exactly(pieces, [])[1].tolist() == [0]


def test_encode_and_decode_tables(spark, pieces):
    rows = documents()
    got = encode(frame(spark, rows))
    assert got.columns == [*frame(spark, rows).columns, "ids", "n_ids", "round_trip"]
    kept = got.collect()
    assert len(kept) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in kept)
    assert sortable(decode(got).collect()) == sortable([(r[0], r[1] or "") for r in rows])
    clash = frame(spark, rows).withColumnRenamed("h", "IDS")
    assert encode(clash).columns[-3:] == ["_ids", "n_ids", "round_trip"]
    assert encode(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 6, 14, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    expected, paths = [], []
    for f in range(4):
        sizes = rng.integers(0, 9, 30).tolist() if f else []
        ids = np.concatenate([np.append(rng.integers(3, 60_000, n), 2) for n in sizes] or [np.zeros(0)])
        if f == 2:
            ids = np.append(ids, [5, 6, 7])
        path = str(tmp_path / f"{f}.bin")
        ids.astype("<u2").tofile(path)
        paths.append((path,))
        expected += [(path, i, n, True) for i, n in enumerate(sizes)] + ([(path, 30, 3, False)] if f == 2 else [])
    got = count_tokens(spark.createDataFrame([*paths, (None,)], "path string"), end=2, block_bytes=block).collect()
    assert sortable(got) == sortable(expected)


def test_counts_of_documents(spark):
    rows = documents()
    with open(RANKS, "rb") as f:
        encode = encoding(f.read()).encode_ordinary
    assert encode("Hello world") == [15496, 995]
    expected = [(r[0], len(encode(r[1] or ""))) for r in rows]
    assert sortable(document_token_counts(frame(spark, rows), block_bytes=1000).collect()) == sortable(expected)
    assert document_token_counts(frame(spark, rows).limit(0)).count() == 0


def test_checkpoints_need_a_shared_folder(spark):
    use_checkpoints(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_long_blanks_keep_their_ids(monkeypatch):
    with open(RANKS, "rb") as f:
        table = encoding(f.read())
    rng = np.random.default_rng(4)
    signs = [" ", "\n", "\t", "\u3000", "\x1c", "a", "'s", "!", "7", "é"]
    short = re.compile(token_counts._BLANKS.pattern.replace(str(RUN), "3"))
    monkeypatch.setattr(token_counts, "RUN", 0)
    monkeypatch.setattr(token_counts, "_BLANKS", short)
    for _ in range(300):
        text = "".join(x * int(n) for x, n in zip(rng.choice(signs, 12), rng.integers(1, 7, 12)))
        assert encoded(table, text) == table.encode_ordinary(text)


def test_very_long_blank_and_solid_texts(spark):
    with open(RANKS, "rb") as f:
        table = encoding(f.read())
    texts = [" " * 5_000_000, "word" + "\n" * 2_000_000 + "x", "plain text", "a" * 1_000_000]
    got = {r.doc_id: r.n_tokens for r in document_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 5_000_000, 1: 1 + len(table._encode_single_piece("\n" * 1_999_999)) + 2, 2: 2, 3: len(table.encode_ordinary(texts[3]))}


def test_many_long_runs_of_blanks_take_linear_time():
    with open(token_counts.RANKS, "rb") as f:
        table = token_counts.encoding(f.read())
    text = ("x" + " " * (token_counts.RUN - 1)) * 10 + "y"
    start = time.perf_counter()
    ids = token_counts.encoded(table, text)
    assert time.perf_counter() - start < 20
    assert table.decode(ids) == text
    # The merges of a piece by itself, which the library offers under a private name, are those of the whole text.
    for piece in (" " * 70, "\n" * 33, "\t \t" * 9):
        assert table._encode_single_piece(piece) == table.encode_ordinary(piece)
