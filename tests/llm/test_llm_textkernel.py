import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gauntlet.llm import textkernel as tk
from llm_helpers import WORD


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x0c\x85 ß", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    got = []
    for chunk in tk.chunks(pa.array(texts, pa.string())):
        starts, ends, rows = chunk.words()
        found = [chunk.data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
        got += [found[rows[r]:rows[r + 1]] for r in range(len(chunk))]
    assert got == [WORD.findall(t or "") for t in texts]


def test_hash_depends_on_the_word_and_not_on_its_place():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    sequence = [rng.choice(vocabulary) for _ in range(5000)]
    (chunk,) = tk.chunks(pa.array([" ".join(sequence)]))
    starts, ends, _ = chunk.words()
    hashes = tk.span_hashes(chunk.data, starts, ends)
    assert len({(w, h) for w, h in zip(sequence, hashes.tolist())}) == len(set(sequence)) == len(set(hashes.tolist()))


def test_chunks_cover_sliced_arrays_and_long_texts(monkeypatch):
    texts = ["a b", None, "x" * 50 + " y", "", "c c c"]
    whole = [c for c in tk.chunks(pa.array(["zz", *texts]).slice(1))]
    monkeypatch.setattr(tk, "CHUNK_BYTES", 8)
    small = [c for c in tk.chunks(pa.array(texts))]
    join = lambda cs: b"".join(c.data.tobytes() for c in cs)
    assert join(whole) == join(small) == "".join(t or "" for t in texts).encode() and len(small) > 1
    hashes = [np.concatenate([tk.span_hashes(c.data, *c.words()[:2]) for c in cs]).tolist() for cs in (whole, small)]
    assert hashes[0] == hashes[1]


def test_shingle_sets():
    w = np.arange(1, 9, dtype=np.uint64)
    assert len(tk.shingle_set(w, 5)) == 4 and len(tk.shingle_set(w[:3], 5)) == 1 and not len(tk.shingle_set(w[:0], 5))
    assert tk.shingle_set(np.ones(9, np.uint64), 5).size == 1
