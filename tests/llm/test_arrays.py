"""Words, hashes and packed key sets."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recallscope.llm import arrays, exchange
from tests.llm.util import ODD_TEXTS, words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1cé你 Z", max_size=30)), max_size=12)


@settings(max_examples=80, deadline=None)
@given(texts)
def test_words_are_the_regex_words(rows):
    rows = rows + [t for _, t in ODD_TEXTS]
    w = arrays.Words(*arrays.utf8(pa.chunked_array([pa.array(rows[:3], pa.string()), pa.array(rows[3:], pa.string())])))
    data = w.data.tobytes()
    got = [[data[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in rows]
    by = {}
    for word, h in zip((x for t in rows for x in words(t)), w.hash.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_windows_tell_sequences_apart():
    rows = [t for _, t in ODD_TEXTS if t]
    w = arrays.Words(*arrays.utf8(pa.array(rows, pa.string())))
    flat = [x for t in rows for x in words(t)]
    for n in (1, 2, 5, 50):
        for which in (0, 1):
            h, inside = w.windows(n, which)
            seen = {}
            for i in np.flatnonzero(inside).tolist():
                assert seen.setdefault(tuple(flat[i : i + n]), h[i]) == h[i]
            assert len(set(seen.values())) == len(seen)
            assert inside.sum() == sum(max(0, len(words(t)) - n + 1) for t in rows)


def test_ascii_lower_folds_only_a_to_z():
    a, b = (arrays.Words(*arrays.utf8(pa.array([t], pa.string())), ascii_lower=True).hash for t in ("ABz É", "abz É"))
    assert (a == b).all()
    assert arrays.Words(*arrays.utf8(pa.array(["é"], pa.string())), ascii_lower=True).hash[0] != b[1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_keys_and_values_round_trip(keys):
    k = np.array(sorted(keys), dtype=np.uint64)
    assert (exchange.unpack_keys(exchange.pack_keys(k)) == k).all()
    assert (exchange.unplanes(exchange.planes(k)) == k).all()
    assert (arrays.distinct(np.concatenate([k, k])) == k).all()
    uniq, place = arrays.numbered(np.concatenate([k[::-1], k]))
    assert (uniq == k).all() and (uniq[place] == np.concatenate([k[::-1], k])).all()


def test_byte_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 100, 0, 1, 2, 3)] + [None])], names=["t"])
    parts = list(arrays.byte_slices(batch, 0, limit=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2
