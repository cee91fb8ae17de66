"""The memory of a search task: bounded by the shard, whatever the texts."""

import tracemalloc

from qualispark.llm import decontaminate as dec


def test_a_task_holds_one_small_shard():
    phrases = [dec.Phrases([("a", b"w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], dec.WINDOW)]
    text = " ".join(f"w{i % 1000}" for i in range(5000)).encode()

    def peak(shard_words):
        tracemalloc.start()
        try:
            found = [(d.n_words, d.merged(), d.items) for d in dec._search_texts((text for _ in range(160)), phrases, shard_words)]
            return found, tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    small, most = peak(dec.SHARD_WORDS)
    large, more = peak(1_000_000)
    assert small == large and len(small) == 160 and small[0][1]
    assert most < 0.5 * more
