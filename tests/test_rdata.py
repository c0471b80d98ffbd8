"""R serialization: round trips, and streams put together by hand from the format's description."""

import gzip
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.sources import rdata as r


def same(a, b):
    assert type(a) is type(b)
    if isinstance(a, r.Vector):
        assert a.kind == b.kind and a.attrs.keys() == b.attrs.keys() and len(a) == len(b)
        for k in a.attrs:
            same(a.attrs[k], b.attrs[k])
        if a.kind in r.DTYPES:
            assert np.array_equal(np.asarray(a.values), np.asarray(b.values), equal_nan=a.kind in ("double", "complex"))
        else:
            for x, y in zip(a.values, b.values, strict=True):
                same(x, y)
    elif isinstance(a, r.S4):
        assert list(a.attrs) == list(b.attrs)
        for k in a.attrs:
            same(a.attrs[k], b.attrs[k])
    elif isinstance(a, r.Pairs):
        assert a.call == b.call and [t for t, _ in a.items] == [t for t, _ in b.items]
        for (_, x), (_, y) in zip(a.items, b.items, strict=True):
            same(x, y)
    else:
        assert a == b


atoms = st.one_of(
    st.none(),
    st.lists(st.integers(-(2**31), 2**31 - 1), max_size=5).map(r.ints),
    st.lists(st.floats(width=64), max_size=5).map(r.doubles),
    st.lists(st.one_of(st.none(), st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=6)), max_size=4).map(lambda v: r.strings(*v)),
    st.binary(max_size=9).map(lambda b: r.Vector("raw", b)),
    st.lists(st.sampled_from([0, 1, r.NA_INT]), max_size=4).map(lambda v: r.Vector("logical", np.array(v, np.int32))),
)
tags = st.text("abcxyz.", min_size=1, max_size=4)
objects = st.recursive(
    atoms,
    lambda inner: st.one_of(
        st.dictionaries(tags, inner, max_size=4).map(r.named),
        st.dictionaries(tags, inner, min_size=1, max_size=4).map(r.S4),
        st.lists(st.tuples(st.one_of(st.none(), tags), inner), min_size=1, max_size=4).map(r.Pairs),
    ),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(objects)
def test_round_trip(x):
    same(r.loads(r.dumps(x)), x)
    same(r.loads(r.dumps(x, compress=False)), x)


def stream(body: bytes, version: int = 3) -> bytes:
    head = b"X\n" + struct.pack(">iii", version, 4 << 16 | 2 << 8, 3 << 16 | 5 << 8)
    return head + (struct.pack(">i", 5) + b"UTF-8" if version == 3 else b"") + body


def i(*n: int) -> bytes:
    return struct.pack(f">{len(n)}i", *n)


def sym(name: str) -> bytes:
    return i(1, 9 | 64 << 12, len(name)) + name.encode()


def test_integer_vector_with_names():
    body = i(13 | 0x200, 2, 7, r.NA_INT) + i(2 | 0x400) + sym("names") + i(16, 2) + i(9 | 64 << 12, 1) + b"a" + i(9, -1) + i(254)
    got = r.loads(gzip.compress(stream(body)))
    assert got.values.tolist() == [7, r.NA_INT] and got.names == ["a", None]


def altrep(name: str, state: bytes) -> bytes:
    info = i(2) + sym(name) + i(2) + sym("base") + i(2) + i(13, 1, 13) + i(254)
    return i(238) + info + state + i(254)


def test_compact_vectors():
    seq = i(14, 3) + struct.pack(">3d", 4, 2, 1)
    assert r.loads(stream(altrep("compact_intseq", seq))).values.tolist() == [2, 3, 4, 5]
    assert r.loads(stream(altrep("compact_realseq", seq))).kind == "double"
    of = i(2) + i(13, 2, 5, r.NA_INT) + i(2) + i(13, 1, 0) + i(254)
    assert r.loads(stream(altrep("deferred_string", of))).values == ["5", None]
    assert r.loads(stream(altrep("wrap_integer", i(19, 2) + i(13, 1, 9) + i(13, 2, 0, 0)))).values.tolist() == [9]
    with pytest.raises(ValueError, match="mmap"):
        r.loads(stream(altrep("mmap_real", seq)))


def test_references_and_environments():
    body = i(19, 3) + sym("x") + i(1 << 8 | 255) + i(4, 0) + i(253) + i(2 | 0x400) + sym("v") + i(13, 1, 3) + i(254) + i(254) + i(254)
    a, b, env = r.loads(stream(body, 2)).values
    assert a == b == r.Symbol("x") and env.content["v"].values.tolist() == [3]


def test_long_pairlists_do_not_recurse():
    x = r.Pairs([(f"t{k % 50}", r.ints([k])) for k in range(20_000)])
    assert len(r.loads(r.dumps(x)).items) == 20_000


@pytest.mark.parametrize("data", [b"", b"A\n", b"X\n" + i(9, 0, 0), stream(i(13, 5, 1)), stream(i(99))])
def test_bad_streams_say_so(data):
    with pytest.raises((EOFError, ValueError, struct.error)):
        r.loads(data)
