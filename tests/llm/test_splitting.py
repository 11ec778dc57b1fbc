import random

import pytest

from codexloom.llm import splitting as sp

I = "item_kind string, id string, source string, text string, extra int"
L = "item_kind string, source string, max_chars int, overlap_chars int"
LIMITS = [("section", "html", 300, 30), ("section", "ocr", 120, 40)]


def prose(n, seed):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join(rng.choice(["alpha", "beta", "gamma", "délta", "z" * 50]) for _ in range(rng.randrange(1, 25))) + rng.choice([".", ". ", ".\n", ".\n\n", "; (a) ", ", ", " "]))
    return "".join(out)[:n]


def check(rows, text, most, over):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].piece_start == 0 and rows[-1].piece_end == len(text)
    for r in rows:
        assert 0 < len(r.piece) <= most and r.piece == text[r.piece_start : r.piece_end]
    for a, b in zip(rows, rows[1:]):
        assert b.piece_start == a.piece_end - over
    assert rows[0].piece + "".join(r.piece[over:] for r in rows[1:]) == text


@pytest.mark.parametrize("size, segment", [(64, 128), (100, 400), (1 << 16, 1 << 20)])
def test_round_trip(spark, size, segment):
    texts = {f"i{k}": prose(n, k) for k, n in enumerate([301, 299, 300, 1000, 5000, 121])} | {"solid": "x" * 1234, "blank": " " * 999, "lines": "\n" * 700}
    items = [("section", i, " HTML ", t, 1) for i, t in texts.items()]
    got = sp.split_items(spark.createDataFrame(items + items[:3], I), spark.createDataFrame(LIMITS, L), ["id"], size=size, halo=16, segment=segment).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {i for i, t in texts.items() if len(t) > 300}
    for i, rows in by.items():
        check(rows, texts[i], 300, 30)


def test_prefers_natural_boundaries():
    text = "One two three four. Five six seven. " * 4 + "\n\n" + "Next paragraph here, with words. " * 9
    cuts = sp.boundaries(text, 0, 0, len(text))
    pieces = sp.choose_cuts(len(text), cuts, 200, 20)
    assert text[: pieces[0][1]].endswith("\n\n")
    assert all(text[:e].rstrip().endswith((".", ",")) for _, e in pieces)


def test_halves_of_a_range_agree():
    text = prose(4000, 9)
    whole = sp.boundaries(text, 0, 0, len(text))
    parts = [c for r in range(0, 4000, 500) for c in sp.boundaries(text[max(0, r - 64) : r + 564], max(0, r - 64), r, r + 500)]
    assert parts == whole


def test_nulls_unknown_sources_and_empties(spark):
    rows = [("section", None, "html", "word " * 100, 1), ("section", "a", None, "word " * 100, 1), ("section", "b", "fax", "word " * 100, 1), ("section", "c", "html", None, 1), ("section", "d", "html", "", 1), (None, "e", "html", "word " * 100, 1)]
    got = sp.split_items(spark.createDataFrame(rows, I), spark.createDataFrame(LIMITS, L), ["id", "extra"], segment=1 << 20).collect()
    assert {r.id for r in got} == {None} and len(got) == 2
    assert sp.split_items(spark.createDataFrame([], I), spark.createDataFrame(LIMITS, L), ["id"]).count() == 0


@pytest.mark.parametrize("text, over", [(prose(20_000, 4) + "日本語のテキスト。" * 400, 0), ("é" * 997 * 5, 0), ("x" + "😀" * 3000, 30), ("", 0)])
def test_files_by_byte_range(spark, tmp_path, text, over):
    p = tmp_path / "big.txt"
    p.write_bytes(text.encode())
    rows = sp.split_files(spark, [str(p), str(p)], 100, over, size=1024, halo=64, segment=4096).collect()
    if text:
        check(rows, text, 100, over)
    else:
        assert [(r.piece_no, r.piece) for r in rows] == [(1, "")]


def test_bytes_that_are_no_text(spark, tmp_path):
    p = tmp_path / "bad.txt"
    p.write_bytes(b"word \xff\xc3 word. " * 500)
    rows = sorted(sp.split_files(spark, [str(p)], 90, 0, size=512, halo=32, segment=2048).collect(), key=lambda r: r.piece_no)
    assert "".join(r.piece for r in rows).count("word") == 1000 and all(len(r.piece) <= 90 for r in rows)


def test_every_blank_is_a_boundary_and_the_last_that_fits_is_taken():
    text = "ab " * 40
    cuts = sp.boundaries(text, 0, 0, len(text))
    assert [c >> 3 for c in cuts if c & 7 == sp.WORD] == list(range(3, 120, 3))
    assert sp.choose_cuts(len(text), cuts, 50, 0)[0] == (0, 48)
    half = len(text) // 2
    assert sp.boundaries(text[: half + 9], 0, 0, half) + sp.boundaries(text[half - 9 :], half - 9, half, len(text)) == cuts
