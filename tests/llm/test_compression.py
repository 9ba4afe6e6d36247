from feedlake.llm.compression import BLOCK, drawn


def test_dictionaries_hold_blocks_of_all_positions():
    texts = [f"{i:04d}" * 5000 for i in range(50)]
    starts = "".join(t[:512] for t in texts)
    texts = [t[:10_000] + f"<{i:03d}>" + t[10_000:] for i, t in enumerate(texts)]
    book = drawn(texts, 1 << 19)
    assert (1 << 19) - BLOCK < len(book) <= 1 << 19
    marks = sum(f"<{i:03d}>".encode() in book for i in range(50))
    assert 10 <= marks and "<" not in starts
    assert drawn(texts, 1 << 30).count(b"<") == 50 and drawn([], 100) == b""
