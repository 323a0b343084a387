"""Every word and every window of a text reaches the toxicity network."""

import random

from dubflow.llm import toxicity


def test_long_words_reach_the_network():
    net = toxicity.Network({})
    for middle in ("vileman", "毒毒毒", "!!!!" * 40):
        plain, marked = "河" * 90 + "x" * 300, "河" * 90 + middle + "x" * 300
        got = toxicity.Scorer(net).scores([plain[:-1] + "y", plain, marked, plain[:93] + middle + plain[93:]])
        assert len(set(got.tolist())) == 4, middle
    rng = random.Random(4)
    for n in (1, 24, 25, 32, 96, 97, 98, 500, 5000):
        word = "".join(rng.choice("aé字🙂!") for _ in range(n))
        got = toxicity.split_words(f"a {word} b")
        assert got[0] == "a" and got[-1] == "b"
        whole = ""
        for k, p in enumerate(got[1:-1]):
            raw = toxicity.bare(p) if len(got) > 3 else p
            assert len(raw.encode()) <= toxicity.PIECE
            shared = next(s for s in range(1, 25) if whole.endswith(raw[:s]) and len(raw[:s].encode()) >= toxicity.SHARED) if k else 0
            whole += raw[shared:]
        assert whole == word


def test_training_sees_every_window(spark, monkeypatch):
    rows = [(k, " ".join(["calm"] * 68 + ["vileman"] * (k % 2) + ["tree"] * (1100 - k))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, inner = set(), toxicity._windows_of
    monkeypatch.setattr(toxicity, "_windows_of", lambda ids, spans: seen.update((len(d), s) for d, some in zip(ids, spans) for s in some) or inner(ids, spans))
    net = toxicity.fit_toxicity(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic"))
    assert "vileman" in net.vocabulary
    sizes = {n for n, _ in seen}
    assert len(sizes) > 4 and min(sizes) > 1100 and seen == {(n, s) for n in sizes for s in toxicity.windows(n)}
