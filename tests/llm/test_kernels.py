"""Kernels against plain versions or the libraries they must agree with."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from marlpit.llm import bpe, fingerprints, minhash, suffix_array, textkernel, token_counts

ODD = ["", " ", "a" * 700, "Hello  world\n\n it's 12345!", "日本語" * 90, "x́ " * 50, " " * 400 + "b", "naïve café <|endoftext|> ok", "\x1c\t\r\n", "antidisestablishmentarianism" * 12]


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def test_encoding_is_the_library_s(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    encoder = bpe.Encoder(bpe.Bpe.from_rank_lines(ranks), public_tokenizers.PATTERN)
    got = [*encoder(ODD)]
    assert got == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in ODD]
    assert [bpe.decode_ids(x, encoder.bpe.tokens).decode() for x in got] == ODD


def test_counts_are_the_library_s():
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        spec = json.load(f)
    proven = token_counts.whole_tokens(bpe.Bpe.from_merges(spec["model"]["vocab"], spec["model"]["merges"]))
    counter = token_counts.Counter(spec, proven, public_tokenizers.PATTERN)
    library = Tokenizer.from_file(path)
    assert counter(ODD) == [len(e.ids) for e in library.encode_batch(ODD, add_special_tokens=False)]
    assert len(proven) > 40_000


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for trial in range(60):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 200)) if trial % 3 else np.tile(rng.integers(0, 3, rng.integers(1, 6)), 40)
        b = bytes(t.astype(np.uint8))
        order = suffix_array.suffix_array(t.astype(np.int64))
        assert list(order) == sorted(range(len(b)), key=lambda i: b[i:])
        prefix = suffix_array.common_prefixes(t.astype(np.uint8), order, len(b) - np.arange(len(b)))
        for r in range(1, len(b)):
            x, y = b[order[r] :], b[order[r - 1] :]
            assert prefix[r] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_induced_sorting_of_large_alphabets():
    rng = np.random.default_rng(5)
    for trial in range(600):
        n = int(rng.integers(0, 80))
        t = rng.integers(0, rng.integers(1, 90), n)
        t = [t, np.sort(t), np.sort(t)[::-1], np.repeat(t, rng.integers(1, 5, n)), np.tile(t, 3)][trial % 5]
        assert suffix_array.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_scans_read_buckets_in_blocks():
    rng = np.random.default_rng(6)

    def reads(text):
        text = np.unique(text, return_inverse=True)[1]
        letters = int(text.max()) + 1
        above, below = suffix_array.blocks(text, suffix_array.smaller_than_next(text), letters)
        low, up = 0, 0
        while low < letters:
            low, up = int(above[low]), up + 1
        high, down = letters - 1, 0
        while high >= 0:
            high, down = int(below[high]), down + 1
        return up, down

    # As a shard has them: a symbol for each core between bytes, then the end of the member.
    members = [np.concatenate([rng.integers(97, 123, 16), [300 + g], rng.integers(97, 123, 16), [0]]) for g in range(5000) for _ in range(2)]
    assert max(reads(np.concatenate(members))) <= 28
    assert max(reads(rng.integers(0, 100_000, 100_000))) < 2000


def test_word_and_shingle_hashes():
    texts = [b"The cat  sat\ton THE mat", b"", b"one", b"the CAT sat on the mat"]
    words, offsets = textkernel.hash_words(texts)
    assert list(np.diff(offsets)) == [6, 0, 1, 6] and (words[:6] == words[7:]).all() and words[0] == words[4]
    runs, at = textkernel.shingle_hashes(words, offsets, 5)
    assert list(np.diff(at)) == [2, 0, 1, 2] and (runs[:2] == runs[3:]).all()


def test_minhash_estimates_similarity():
    base = [f"w{k}" for k in range(400)]
    other = base[:360] + [f"x{k}" for k in range(40)]
    sets, offsets = minhash.shingle_sets([" ".join(base).encode(), " ".join(other).encode()], 5)
    a, b = ({*sets[offsets[k] : offsets[k + 1]].tolist()} for k in (0, 1))
    rows = minhash.minima(sets, offsets)
    assert abs((rows[0] == rows[1]).mean() - len(a & b) / len(a | b)) < 0.12


def test_fingerprints_are_homomorphic():
    one, two, both, swapped = fingerprints.pack(*fingerprints.fingerprint_many([b"a b c\nd e", b"f g", b"a b c\nd e\nf g", b"f g\n\nd e\na b c"]))
    assert both == swapped != one and fingerprints.combine([one], [two]) == [both] and fingerprints.combine([both], [two], -1) == [one]
    assert fingerprints.likeness(fingerprints.unpack([both]), fingerprints.unpack([one]))[0] > 0.5
