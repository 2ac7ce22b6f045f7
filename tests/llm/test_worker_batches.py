"""What a worker makes of a batch at once is bounded."""

import pyarrow as pa

from lodestone.llm import neardup


class _Docs:
    """Stands for a DataFrame and gives the worker's function as it is."""

    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_sets_leave_a_worker_in_small_batches():
    texts = [f"a b c d e {k % 1500}" for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = list(neardup.full_sets(_Docs(), 5)(iter([batch])))
    assert max(b.num_rows for b in found) <= 1024
    known = neardup._WordHashes()
    sets = [neardup.shingles(t, 5, known).tobytes() for t in texts]
    assert [s for b in found for s in b.column("set").to_pylist()] == sets
