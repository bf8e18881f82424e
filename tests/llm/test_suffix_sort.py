import numpy as np
import pytest

from kinloom.llm.suffix_sort import PAD, share_prefix, sorted_suffixes


@pytest.mark.parametrize("alphabet,n", [(1, 200), (2, 400), (4, 1500), (256, 1500)])
@pytest.mark.parametrize("share", [0.1, 1.0])
def test_order_equals_sorting(alphabet, n, share):
    rng = np.random.default_rng(alphabet)
    body = rng.integers(0, alphabet, n).astype(np.uint8) + (97 if alphabet < 256 else 0)
    body[n // 2 : n // 2 + n // 4] = body[: n // 4]
    text = np.concatenate([body, np.zeros(PAD, np.uint8)]).astype(np.uint8)
    chosen = np.zeros(len(text), bool)
    chosen[:n][rng.random(n) < share] = True
    order = sorted_suffixes(text, chosen, 50)
    assert sorted(order.tolist()) == np.flatnonzero(chosen).tolist()
    data = text.tobytes()
    got = [data[i : i + 50] for i in order]
    assert got == sorted(got)
    assert share_prefix(text, order, 50).tolist() == [a[:50] == b[:50] for a, b in zip(got, got[1:])]
