import hashlib
import tracemalloc

import numpy as np
import pytest

from provena.llm import induced


def naive(text):
    raw = [tuple(text[i:]) for i in range(len(text))]
    order = sorted(range(len(text)), key=lambda i: raw[i])
    common = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while raw[a][k : k + 1] and raw[a][k : k + 1] == raw[b][k : k + 1]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("seed", range(40))
def test_matches_naive(seed):
    rng = np.random.default_rng(seed)
    body = rng.integers(1, 2 + seed % 7, rng.integers(1, 200))
    if seed % 3 == 0:
        body = np.concatenate([body, body[: len(body) // 2], body])
    text = np.append(body, 0).astype(np.int16)
    order, common = induced.suffix_array(text, memory=0 if seed % 2 else 1 << 20)
    want = naive(text.tolist())
    assert order.tolist() == want[0]
    assert common.tolist() == want[1]


def test_runs_and_single():
    for text in ([0], [1, 0], [1] * 50 + [0], [2, 1] * 30 + [0], [3, 3, 1, 1, 2, 2, 0]):
        order, common = induced.suffix_array(np.array(text, np.int16))
        assert (order.tolist(), common.tolist()) == naive(text)


def test_far_beyond_memory():
    rng = np.random.default_rng(1)
    body = rng.integers(2, 30, 250_000).astype(np.int16)
    text = np.concatenate([body, [1], body[1000:200_000], body[:50_000], rng.integers(2, 4, 100_000), [0]]).astype(np.int16)
    space = induced.Space(100_000)
    tracemalloc.start()
    again, before, n = np.zeros(len(text), bool), 0, 0
    for p, common in induced.sorted_suffixes(text, 200, space):
        found = common >= 200
        again[p[found]] = again[np.append(before, p[:-1])[found]] = True
        before, n = p[-1], n + len(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and space.spilled > 100 * space.limit and peak < space.spilled / 2
    raw = (text + 0).astype(np.uint8).tobytes()
    seen = {}
    for k in range(len(raw) - 199):
        seen.setdefault(hashlib.md5(raw[k : k + 200]).digest(), []).append(k)
    want = np.zeros(len(text), bool)
    for places in seen.values():
        if len(places) > 1:
            want[places] = True
    assert (again == want).all()


def test_recursion_orders_like_one_level():
    rng = np.random.default_rng(4)
    text = np.append(np.concatenate([rng.integers(1, 5, 3000)] * 3 + [rng.integers(1, 3, 4000)]), 0).astype(np.int16)
    order, common = induced.suffix_array(text, memory=0)
    want = induced.suffix_array(text, memory=1 << 30)
    assert (order == want[0]).all() and (common == want[1]).all()
