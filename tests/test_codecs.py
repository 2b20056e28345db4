import numpy as np
import pytest
from fixtures import P2OBS

from tidemark.functions import codecs as c
from tidemark.operators.p2 import Histogram, Quantile
from tidemark.operators.sketches import Conservative, Shape


def fed(m, n):
    for x in P2OBS[:n]:
        m.add(x)
    return m


@pytest.mark.parametrize("n", [0, 3, 5, 20])
def test_markers(n):
    q, h = fed(Quantile(0.5), n), fed(Histogram(4), n)
    for m, read in ((c.unpack_quantile(c.pack_quantile(q), 0.5), q), (c.unpack_histogram(c.pack_histogram(h), 4), h)):
        assert (m.heights, m.positions) == (read.heights, read.positions)
        for x in P2OBS:
            m.add(x)
            read.add(x)
        assert (m.heights, m.positions) == (read.heights, read.positions)


def test_error_codes():
    q = c.pack_quantile(Quantile(0.5))
    assert len(q) == 126
    assert [c.error_code(lambda d=d, p=p: c.unpack_quantile(d, p)) for d, p in ((q, 0.5), (q[:-1], 0.5), (b"\x06\x00" + q[2:], 0.5), (q, 0.25))] == [0, 1, 2, 3]
    h = c.pack_histogram(Histogram(4))
    assert [c.error_code(lambda d=d: c.unpack_histogram(d, 4)) for d in (h, h + b"x", b"\x07\x00" + h[2:])] == [0, 1, 2]
    s = c.pack_stats(3, 2, 2)
    assert [c.error_code(lambda d=d: c.unpack_stats(d)) for d in (s, s[1:], c.pack_stats(-1, 0, 0))] == [0, 1, 2]
    m = c.pack_matrix(np.array([[1, 2], [3, 4]], np.int32))
    assert [c.error_code(lambda d=d, r=r, k=k: c.unpack_matrix(d, r, k)) for d, r, k in ((m, 2, 2), (m[:-1], 2, 2), (m, 4, 1), (m[:4] + b"\x01" + m[5:], 2, 2))] == [0, 1, 2, 3]
    t = c.pack_ring(70, 10, [1, 2, 3])
    assert len(t) == 24 + 12 and c.unpack_ring(t, 3, 10) == (70, [1, 2, 3])
    assert [c.error_code(lambda d=d, r=r, n=n: c.unpack_ring(d, r, n)) for d, r, n in ((t, 3, 10), (t[:-1], 3, 10), (t, 3, 11))] == [0, 1, 2]


def test_sketch_and_matrix():
    shape = Shape(0.01, 0.01)
    s = Conservative(shape)
    for k, n in ((b"a", 1), (b"b", 1), (b"c", 3)):
        s.update(k, n)
    r = c.unpack_sketch(c.pack_sketch(s), shape)
    assert (r.items, r.unique, r.query(b"c")) == (5, 3, 3)
    assert c.error_code(lambda: c.unpack_sketch(b"", shape)) == 1
    f = np.array([[33.0], [np.inf], [44.0]], np.float32)
    assert (c.unpack_matrix(c.pack_matrix(f), 3, 1, "float") == f).all()
