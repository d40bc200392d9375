import tracemalloc

import numpy as np

from askloom.llm.words import Words, gram_hashes


def test_hashes_do_not_depend_on_the_parts():
    texts = ["some words and more", None, "", "x" * 500 + " y", " é\tü\n" * 40, "one"]
    words = Words(texts, lower=True)
    whole = words.hashes()
    assert len(np.unique(whole)) == 9
    for limit in (1, 7, 64, 1000):
        assert np.array_equal(words.hashes(limit), whole)
    assert np.array_equal(Words(["one"]).hashes(), whole[-1:])


def test_memory_of_one_long_text():
    text = "some words of a text " * 500_000  # 10.5 MB
    Words(["a " * (1 << 19)]).hashes()  # tables
    tracemalloc.start()
    gram_hashes(Words([text]).hashes(), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(text)
