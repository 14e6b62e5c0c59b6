"""Counts and windows of byte pairs in one pass."""

from tarn.functions.tokens import BytePairs


def test_counted_windows_take_a_text_apart_once():
    ranks = {bytes([i]): i for i in range(256)} | {b"th": 256, b"the": 257, b" k": 258, b" ki": 259, "é".encode(): 260}
    for text in ("", " ", "the kite", " the kite\n", "thé the the kite " * 9, "the" * 50, "日本 the\x85"):
        plain, once = BytePairs(ranks), BytePairs(ranks)
        passes = []
        once.words = type("W", (), {"findall": staticmethod(lambda t: passes.append(t) or plain.words.findall(t))})
        for size, overlap in ((3, 1), (400, 40)):
            passes.clear()
            assert once.counted_windows(text, size, overlap) == (plain.count(text), plain.windows(text, size, overlap))
            assert len(passes) == (1 if text == text.strip() else 2)
