import zlib
from itertools import permutations

import numpy as np
import pytest

from kinloom.llm import packing
from kinloom.llm.packing import best_fit_decreasing, lower_bound, pack_documents, pack_remainders, text_parts
from kinloom.llm.queries import tokenizer_files

TEXTS = ["", None, "plain words here " * 700, "Ünïcödé “quotes” — €5 ½ ²", "漢字 and 🙂 emoji nbsp\x85nel sep", "<|endoftext|> a", "hello <|endoftext|> world", "  \n\n\t x", "don't you'll", "a" * 5000, "العربية १२३", "x"]


def test_pieces_are_the_tokenizers_own_and_sequences_are_gapless(spark):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    own = Tokenizer.from_file(files["tokenizer_path"])  # no option is set: the plain call decides
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta", "nuß", "12", "--"], int(rng.integers(1, 2500)))) for _ in range(60)]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(1, "again", 6), (None, "no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    out = pack_documents(docs, **files, part_rows=20).collect()
    want = []
    for i, t, _ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.05 * (sum(r.length for r in out) // 1024 + 1)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), **tokenizer_files()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_bound_is_below_the_best_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 12, 7)
    best = 99
    for p in set(permutations(lengths.tolist())):
        n, room = 0, 0
        for x in p:
            if x > room:
                n, room = n + 1, 12
            room -= x
        best = min(best, n)
    bound = lower_bound(np.bincount(lengths, minlength=13), 12)
    _, _, n = best_fit_decreasing(lengths, 12)
    assert bound <= best <= n


def test_exchange_rounds_keep_every_item_once(spark):
    rng = np.random.default_rng(0)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(1, 1024, 900))], "uid long, length long")
    out = pack_remainders(items, part_rows=60).collect()
    assert sorted(r.uid for r in out) == list(range(900))


def test_exchange_lowers_the_number_of_sequences(spark):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(200, 520, 1200))], "uid long, length long")
    bins = [len({r.sequence_id for r in pack_remainders(items, part_rows=40, rounds=rounds).collect()}) for rounds in (1, 4)]
    assert bins[1] < bins[0]


def test_cut_texts_have_the_same_ids(monkeypatch):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_files()["tokenizer_path"])
    rng = np.random.default_rng(9)
    plain = ["alpha", "Beta's", "nuß", "12", "--", " ", "\n", "<|endoftext|>", "don't", "a b", "\t x", "'s", "…x", "¡9", "\r\n", "  ", "€5"]
    other = ["漢字", "🙂", "\x85", "\u00a0", "½", "\u2028", "ΑΒΓ", "\x1c", "\u200b"]
    texts = []
    for words in (plain, plain + other):
        texts += ["".join(w + rng.choice(["", " ", "  "]) for w in rng.choice(words, int(rng.integers(0, 300)))) for _ in range(300)]
    texts += ["x" * 3000, "", " ", "\n\n", " a", "a ", "\n a", " \n", "a  b", "a \n b"]
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    encode, slow = packing.Encoder(**tokenizer_files()), packing.Encoder(tokenizer_files()["tokenizer_path"])
    assert sum(len(text_parts(t, 50)) > 1 for t in texts) > 100 and all("".join(text_parts(t, 50)) == t for t in texts)
    assert sum(packing.PLAIN.fullmatch(t) is not None for t in texts) > 300 and slow.fast is None and encode.fast is not None
    assert [t for t in texts if encode(t) != own.encode(t, add_special_tokens=False).ids or slow(t) != encode(t)] == []


def test_carried_columns_and_ids(spark):
    docs = spark.createDataFrame([(1, "some words " * 900, 7), (2, None, None)], "doc_id long, text string, copy_no int")
    out = pack_documents(docs, **tokenizer_files(), with_ids=True, carry=("copy_no",)).collect()
    assert {(r.doc_id, r.copy_no) for r in out} == {(1, 7), (2, None)}
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out)
