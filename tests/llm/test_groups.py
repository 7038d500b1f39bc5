"""Groups of rows over batches."""

import pyarrow as pa

from zonalis.llm import simhash


def test_groups_whose_key_ends_in_a_zero_byte_stay_whole():
    keys = [k.ljust(15, b".") + bytes([end]) for k in (b"a", b"b", b"c") for end in (0, 1)]
    dealt = [k for k in keys for _ in range(5)]
    for size in range(1, 12):
        batches = [pa.record_batch([pa.array(dealt[a : a + size], pa.binary()), pa.array([7] * len(dealt[a : a + size]), pa.int32())], ["k", "i"]) for a in range(0, len(dealt), size)]
        got = [t["k"].to_pylist() for t in simhash.whole_groups(iter(batches), ["k", "i"])]
        assert sum(got, []) == dealt and all(x[-1] != y[0] for x, y in zip(got, got[1:]))
