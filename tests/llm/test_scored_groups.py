"""Texts are scored many at a time, and their scores do not depend on how many."""

import numpy as np
import pyarrow as pa

from lodestone.llm import mixer


def test_groups_are_large_and_do_not_change_scores(monkeypatch):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abc de\n"), n)) for n in (30_000, 0, 500, 29_999, 7, 30_000, 30_000, 30_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    code, slots = mixer.Code(np.ones(mixer.SYMBOLS * mixer.SYMBOLS, np.int64)), mixer.LEAST_SLOTS
    size = mixer.NODES + 2 * slots
    packed = (r.integers(100, 156, size) << 8 | r.integers(0, 4, size)).astype("<u2")

    def scores() -> tuple[int, list]:
        out, groups = np.zeros(len(texts)), 0
        for places, raw in mixer._groups(batch, lambda _: True):
            out[places] = mixer.text_bits(code, packed, slots, raw)
            groups += 1
        return groups, out.tolist()

    groups, large = scores()
    assert groups == 1
    monkeypatch.setattr(mixer, "AT_ONCE", 100_000)
    groups, small = scores()
    assert groups > 1
    np.testing.assert_allclose(large, small, rtol=1e-12)
