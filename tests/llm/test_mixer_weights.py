"""The mixing model against a plain loop, and its probabilities against one."""

import math
from collections import defaultdict

import numpy as np
import pytest


def model(mixer, texts, slots):
    """Code and packed tables of training texts, by plain counting."""
    pairs = np.zeros(mixer.SYMBOLS**2, np.int64)
    for t in texts:
        symbols = [mixer.END, *t, mixer.END]
        for a, b in zip(symbols, symbols[1:]):
            pairs[a * mixer.SYMBOLS + b] += 1
    code = mixer.Code(pairs)
    counts = np.zeros((2, mixer.NODES + (len(mixer.LOOKS) - 1) * slots), np.int64)
    for t in texts:
        found = mixer.Decisions(code, [t], slots)
        for k in range(len(mixer.LOOKS)):
            start = mixer.NODES + (k - 1) * slots if k else 0
            for slot, bit in zip(found.slots(k).tolist(), found.bit.tolist()):
                counts[bit, start + slot] += 1
    return code, mixer.packed_odds(*counts)


def bits_by_hand(mixer, code, packed, slots, text, left_out=0):
    """The cost of a text but for its last ``left_out`` decisions, one decision at a time."""
    found = mixer.Decisions(code, [text], slots)
    found.bit = found.bit[: len(found.bit) - left_out]
    places = [found.slots(k).tolist() for k in range(len(mixer.LOOKS))]
    weights = [list(mixer.START) for _ in range(len(mixer.GATES) + 1)]
    cells = defaultdict(lambda: [0.0, 0.0, 0.0])  # hits, ones, ones expected
    moves, seen, total = defaultdict(float), [], 0.0
    limit = mixer.CELLS // 2 - 0.5
    for t, bit in enumerate(found.bit.tolist()):
        entries = [int(packed[(mixer.NODES + (k - 1) * slots if k else 0) + p[t]]) for k, p in enumerate(places)]
        x = [((e >> 8) - 128) * mixer.ODDS_STEP for e in entries]
        gate = entries[-1] & 255
        mixed = max(-limit, min(limit, sum(w * v for w, v in zip(weights[gate], x))))
        chance = 1 / (1 + math.exp(-mixed))
        cell = int(mixed)
        hits, ones, hoped = cells[cell]
        b = mixer.BELIEF
        z = mixed + mixer.SHARE * math.log((ones + b) / (hoped + b) / ((hits - ones + b) / (hits - hoped + b)))
        total += math.log2(1 + math.exp(-z if bit else z))
        for k, v in enumerate(x):
            moves[gate, k] += mixer.RATE * (bit - chance) * v
        seen.append((cell, bit, chance))
        if len(seen) == mixer.STEP:
            for (g, k), step in moves.items():
                weights[g][k] += step
            for c, came, expected in seen:
                cells[c] = [a + b for a, b in zip(cells[c], (1, came, expected))]
            moves.clear()
            seen.clear()
    return total


def test_scores_are_those_of_a_plain_loop():
    from lodestone.llm import mixer

    slots = 1 << 16
    train = [b"the cat sat on the mat " * 30, "über die brücke ".encode() * 40, b"", b"x" * 500]
    code, packed = model(mixer, train, slots)
    texts = [b"", b"a", b"the cat " * 300, "die brücke sat ".encode() * 90, b"\0\xff" * 200, b"the mat"]
    want = [bits_by_hand(mixer, code, packed, slots, t) for t in texts]
    together = mixer.text_bits(code, packed, slots, texts)
    assert together == pytest.approx(want, rel=1e-4)
    alone = [mixer.text_bits(code, packed, slots, [t])[0] for t in texts]
    assert alone == pytest.approx(together.tolist(), rel=1e-6)  # a text's score does not hang on the others


def test_all_continuations_add_up_to_one():
    """Probability of ending here, and of each next byte whatever follows, for several beginnings."""
    from lodestone.llm import mixer

    slots = 1 << 16
    code, packed = model(mixer, [b"abcabd " * 50, b"a\0b"], slots)
    for begin in (b"", b"ab", b"abc" * 40, b"\0"):
        of_end = lambda t: int(code.lengths[(t[-1] if t else mixer.END) * mixer.SYMBOLS + mixer.END])
        before = bits_by_hand(mixer, code, packed, slots, begin, of_end(begin))
        chances = [2 ** (before - bits_by_hand(mixer, code, packed, slots, begin))]
        for c in range(256):
            text = begin + bytes([c])
            chances.append(2 ** (before - bits_by_hand(mixer, code, packed, slots, text, of_end(text))))
        assert sum(chances) == pytest.approx(1, rel=1e-6)
