"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("dubflow.llm")

from dubflow.llm import chat, decontaminate, exact_dedup, jaccard, packing, quality, queries, repeats, sharding, toxicity, warc  # noqa: E402
from dubflow.llm.queries import tokenizer_path  # noqa: E402

#: Extra columns whose names the operators use inside.
DDL = "doc_id long, text string, lang string, n long, key string, token long"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "Ünï", "x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 40, 200)))) for _ in range(12)]
    near = [b.split() for b in base]
    for w in near:
        w[rng.randrange(len(w))] = "changed"
    shared = "".join(rng.choice("abcdef ") for _ in range(500))
    texts = base + base[:5] + [" ".join(w) for w in near] + ["", None, None, "   ", "word", "ab" * 600, "z" * 70_000, "p " + shared, shared + " q", shared + shared]
    return [(k, t, "en", k, "k", k) for k, t in enumerate(texts)] + [(3, base[3], "en", 0, "k", 0), (None, base[2], "en", 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_exact_groups(spark, docs, empty):
    got = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()), key=repr)
    rows = [(r[0], r[1] or "") for r in corpus()]
    want = []
    for i, t in rows:
        ids = [a for a, b in rows if b == t]
        keep = max((a for a in ids if a is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted({t for _, t in rows})
    assert exact_dedup.exact_groups(empty).count() == 0 == exact_dedup.deduplicate(empty).count()


def test_grace_recursion(tmp_path):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        c = b"%d" % rng.randrange(900) * 20
        rows.append((hash(c), hashlib.sha256(c).digest(), rng.randrange(10**6), 1, c))
    batches = [exact_dedup._batch(rows[i : i + 100], exact_dedup.RECORD) for i in range(0, len(rows), 100)]
    got = {bytes(s): (m, n) for s, m, n in exact_dedup.grace(batches, str(tmp_path), budget=20_000)}
    want = {}
    for _, s, m, n, _ in rows:
        a, b = want.get(s, (0, 0))
        want[s] = (max(a, m), b + n)
    assert got == want and not list(tmp_path.iterdir())


def test_collisions_compare_contents():
    t = exact_dedup.ContentTable()
    for c in (b"a", b"b", b"a"):
        t.add(7, c, 1, 1, c)
    assert [r[3] for r in t.rows] == [2, 1]


def test_warc(spark):
    big = "é" * 300_000
    rows = [(1, "http://a/ b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "solo"), (None, "u", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.warc_round_trip(pages, chunk=1000, segment=2000).collect()), key=repr)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        keep = max((a for a, _, x in rows if (x or "") == (h or "") and a is not None), default=None)
        want.append((i, len(p), warc.b32(hashlib.sha1(p).digest()), "response" if i == keep else "revisit", None if i == keep else keep))
    assert got == sorted(want, key=repr)
    many = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, 'copied page', concat('page ', id)) as html")
    got = warc.warc_round_trip(many, segment=5000).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(k, 2997 if k % 3 == 0 and k != 2997 else None) for k in range(3000)}
    manifest = warc.write_archives(many, segment=5000)
    read = warc.read_chunks(manifest, payload=False).selectExpr("spark_partition_id() as p").distinct().count()
    assert read > manifest.count() / 2 > 8  # some two segments a task at most
    chunks = warc.read_chunks(warc.write_archives(pages.where("page_id = 6"), chunk=1000), chunk=1000).orderBy("chunk_no").collect()
    assert b"".join(bytes(c.chunk) for c in chunks) == big.encode() and len(chunks) == 600
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def brute_repeats(texts: list[bytes], least: int) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] = seen.get(t[i : i + least], 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                hit[i : i + least] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_index(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(6)]
    strings = list(dict.fromkeys(("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))).encode() for _ in range(6)))
    weights = [rng.choice((1, 1, 2, 5)) for _ in strings]
    index = repeats.RunLengthIndex(strings, 12, weights)
    hit = {(s, i) for s, a, z in index.repeated() for i in range(a, z + 1)}
    seen: dict[bytes, list] = {}
    for s, t in enumerate(strings):
        for i in range(len(t) - 11):
            seen.setdefault(t[i : i + 12], []).append((s, i))
    assert hit == {p for v in seen.values() if sum(weights[s] for s, _ in v) > 1 for p in v}
    assert index.run_length.sum() == sum(w * (len(s) + 1) for s, w in zip(strings, weights, strict=True))
    for m in (1, 3, 12):
        patterns = [*{t[i : i + m] for t in strings for i in range(len(t) - m + 1)}, b"c" * m, (b"ab" * 6)[:m]]
        want = [sum(w * sum(t[i : i + m] == p for i in range(len(t) - m + 1)) for t, w in zip(strings, weights, strict=True)) for p in patterns]
        assert index.count(np.array([list(p) for p in patterns], np.uint8)).tolist() == want


def removed(rows: list[tuple]) -> list[tuple]:
    want = []
    for (i, t), hit in zip(rows, brute_repeats([t for _, t in rows], 400), strict=True):
        kept = bytes(b for b, h in zip(t, hit, strict=True) if not h)
        want.append((i, len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=repr)


def test_repeats(spark, docs, empty):
    want = removed([(r[0], (r[1] or "").encode()) for r in corpus()])
    assert sorted(map(tuple, repeats.remove_repeats(docs).drop("spans").collect()), key=repr) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_one_key_in_many_blocks(spark):
    """Many texts share one 96-byte string and parts of what follows: its segments are more than a block and are cut anew."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, tails = letters(96), [letters(900) for _ in range(3)]
    texts = [letters(rng.randrange(0, 400)) + core + rng.choice(tails)[rng.choice((0, 0, 200)) : rng.randrange(300, 900)] + letters(300) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    _, spans = repeats.repeated_spans(rows, index_bytes=5_000)
    got = {d: np.zeros(len(t), bool) for d, t in enumerate(texts)}
    for r in spans.collect():
        got[r.doc][r.start : r.end] = True
    for hit, want in zip(got.values(), brute_repeats([t.encode() for t in texts], 400), strict=True):
        assert (hit == want).all()


def test_repeats_whole_table(spark):
    """Every row of sf0.01 against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in table.collect()]
    assert sorted(map(tuple, repeats.remove_repeats(table).drop("spans").collect()), key=repr) == removed(rows)


def test_planted_passages(spark):
    """Passages of over 50 words in two documents each go whole where they have 400 bytes, else they stay, as all other documents do."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnoß", k=rng.randrange(2, 10))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passages = [say(51 + k) for k in range(60)] + ["".join(rng.choices("abc ", k=n)) for n in (397, 398, 399)]
    texts = [f"{say(80)} {at} {t} {at} {say(80)}" for t in passages for at in "AB"] + [say(rng.randrange(60, 300)) for _ in passages]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    sizes = [len(t.encode()) + 2 for t in passages]  # with the blanks around it
    assert {399, 400, 401} <= set(sizes) and all(got[d].n_bytes == len(t.encode()) for d, t in enumerate(texts))
    assert [got[d].n_removed for d in range(len(texts))] == [n * (n >= 400) for n in sizes for _ in (0, 1)] + [0] * len(passages)
    kept = [t.replace(f" {passages[d // 2]} ", "") if d < 2 * len(passages) and sizes[d // 2] >= 400 else t for d, t in enumerate(texts)]
    assert [got[d].kept_sha256 for d in range(len(texts))] == [hashlib.sha256(t.encode()).hexdigest() for t in kept]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_feistel_is_a_permutation(spark, n):
    got = sharding.place(spark.range(n).withColumnRenamed("id", "row"), "row", n, 3, "p")
    assert sorted(r.p for r in got.collect()) == list(range(n))


def test_shards(spark, docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert got and sorted(map(tuple, got), key=repr) == sorted(map(tuple, sharding.shard_documents(docs.repartition(7)).collect()), key=repr)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    texts = {(r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in corpus()}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in got} == texts
    assert sharding.shard_documents(empty).count() == 0


def brute_place(x: int, n: int, seed: int) -> int:
    """The permutation again, in Python's integers."""
    a, b = sharding.sides(n)
    prime = sharding.PRIME
    while True:
        left, right = x % a, x // a
        for k in range(sharding.ROUNDS):
            c = sharding.round_constant(seed, k)
            y = right if k % 2 == 0 else left
            y = pow((y * sharding.FIRST + c) % prime, 2, prime) * sharding.SECOND + c
            if k % 2 == 0:
                left = (left + y % prime) % a
            else:
                right = (right + y % prime) % b
        x = left + right * a
        if x < n:
            return x


def test_places_and_copies(spark):
    got = sharding.place(spark.range(3000).withColumnRenamed("id", "row"), "row", 3000, 5, "p").orderBy("row").collect()
    places = [r.p for r in got]
    assert places == [brute_place(k, 3000, 5) for k in range(3000)]
    assert abs(np.corrcoef(np.arange(3000), places)[0, 1]) < 0.08 and abs(np.corrcoef(places[:-1], places[1:])[0, 1]) < 0.08
    # a third of the rows are equal, without id
    rows = spark.createDataFrame([(None, "same")] * 500 + [(k, f"t{k}") for k in range(1000)], "doc_id long, text string")
    got = sharding.shard_documents(rows).collect()
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(1500)) and sum(r.doc_id is None for r in got) == 500


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    import duckdb

    from tests.test_oracles import DATA, TABLES, plain

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(db.sql(queries.ORACLES[name]).df())


def brute_distance(p: str, t: str) -> int:
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(2)
    for _ in range(200):
        p, t = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        got = decontaminate.myers_search(decontaminate.myers_masks(p), len(p), t, len(p))
        assert got[0] == brute_distance(p, t) if got else brute_distance(p, t) > len(p) or not t


def test_leaks(spark, empty):
    rng = random.Random(4)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))) for k in range(5)] + [(5, None), (6, " ")]
    texts = []
    for k in range(60):
        t = list(items[k % 5][1])
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(0, 2)] = rng.choice(["", "z", "Q"])
        texts.append((k, "some lead " + "".join(t) + " and tail", "x"))
    texts += [(60, None, "x"), (61, "", "x"), (62, "clean words only " * 2000, "x")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {}
    for d, t, _ in texts[:60]:
        for i, p in items[:5]:
            n = brute_distance(decontaminate.normalise(p), decontaminate.normalise(t))
            if n <= int(0.08 * len(p)):
                want[d, i] = n
    assert got == want and len(want) > 20
    small = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench, block_bytes=200).collect()}
    assert small == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, _, _ in texts} - {d for d, _ in want}
    assert decontaminate.find_leaks(empty, bench).count() == 0


def labelled(spark, marked, label):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        bad = k % 3 == 0
        words = [rng.choice(["calm", "tree", "river", "stone", "wind", "light"]) for _ in range(rng.randrange(5, 150))]
        if bad:
            words = [marked(w, rng) for w in words]
        rows.append((k, " ".join(words), 0.5))
        labels.append((k, int(bad) if label == "toxic" else 1 - int(bad)))
    rows += [(400, None, 0.1), (401, "", 0.1)]
    labels += [(7, None), (402, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, f"doc_id long, {label} int")


def test_quality(spark):
    docs, labels = labelled(spark, lambda w, r: w.upper() + "!!", "quality")
    got = quality.score_quality(docs, labels).collect()
    truth = {k: int(k % 3 != 0) for k in range(400)}
    assert len(got) == 402 and all(r.held_out == (quality.crc_fold(r.doc_id) == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert quality.score_quality(docs, labels.limit(0)).count() == 402 and quality.score_quality(docs.limit(0), labels).count() == 0
    assert quality.keep_quality(docs, labels).columns == docs.columns


def test_forward_word_by_word():
    """Gates, states and attention of windows, one word and one unit at a time."""
    net = toxicity.Network({"a": 1}, 5)
    p, rng = net.p, np.random.default_rng(3)
    x = rng.standard_normal((6, toxicity.DIM)).astype(np.float32)
    at = rng.integers(0, 6, (3, 5))
    real = np.arange(5) < np.array([5, 3, 1])[:, None]
    n, sig = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    want = []
    for ids, live in zip(at, real, strict=True):
        ids = ids[live]
        sides = {}
        for d, order in (("f", range(len(ids))), ("b", reversed(range(len(ids))))):
            h, sides[d] = np.zeros(n), [None] * len(ids)
            for s in order:
                i = x[ids[s]] @ p[f"W{d}"] + p[f"b{d}"]
                u = p[f"U{d}"]
                z, r = (sig(i[k * n : k * n + n] + h @ u[:, k * n : k * n + n]) for k in (0, 1))
                c = np.tanh(i[2 * n :] + (r * h) @ u[:, 2 * n :])
                h = (1 - z) * h + z * c
                sides[d][s] = h
        states = [np.concatenate([f, b]) for f, b in zip(sides["f"], sides["b"], strict=True)]
        e = np.array([np.exp(np.tanh(s @ p["A"]) @ p["a"]) for s in states])
        want.append(sum(w * s for w, s in zip(e / e.sum(), states, strict=True)) @ p["o"] + p["o0"][0])
    assert np.allclose(net.forward(x, at, real), want, atol=1e-4)


def test_evidence():
    got = toxicity.evidence(np.array([0, 3, 20, 20, 2, 30]), np.array([9, 200, 0, 200, 0, 30]), 40, 360)
    assert got[0] == got[1] == 0 and got[2] > 0.9 > got[5] > got[3] and got[4] < 0.3 and not toxicity.evidence(np.ones(3), np.ones(3), 0, 9).any()


@pytest.mark.parametrize("seed", range(2))
def test_toxicity_from_few_labels(seed):
    """Some 330 labels of sf0.1, some 40 of them toxic: the ranking of its held-out documents."""
    import duckdb

    rows = duckdb.sql("select doc_id, toxic, text from '/root/testdata/sf0.1/labels.parquet' join '/root/testdata/sf0.1/documents.parquet' using (doc_id) order by hash(doc_id)").fetchall()
    held = [r for r in rows if quality.crc_fold(r[0]) == 0]
    some = [r for r in rows if quality.crc_fold(r[0])][seed * 330 : seed * 330 + 330]
    net = toxicity.train([r[2] for r in some], np.array([r[1] for r in some], np.float32), seed=seed)
    score, y = toxicity.Scorer(net).scores([r[2] for r in held]), np.array([r[1] for r in held], bool)
    assert (score[y][:, None] > score[~y]).mean() > 0.8


def test_gradients():
    net = toxicity.Network({"a": 1, "b": 2}, 3)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, toxicity.DIM))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    at = rng.integers(0, 5, (2, 4))
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    g = np.array([0.7, -0.4])
    _, kept = net.forward(x, at, real, keep=True)
    grad, gx = net.backward(x, at, real, kept, g)
    for name in ("Uf", "Wb", "bb", "A", "a", "o"):
        v, i = net.p[name], np.unravel_index(1, net.p[name].shape)
        v[i] += 1e-3
        up = net.forward(x, at, real) @ g
        v[i] -= 2e-3
        down = net.forward(x, at, real) @ g
        v[i] += 1e-3
        assert abs((up - down) / 2e-3 - grad[name][i]) < 1e-3, name


def test_toxicity(spark):
    docs, labels = labelled(spark, lambda w, r: r.choice([w, w, w, "vileman", "vilest"]), "toxic")
    got = toxicity.score_toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(got) == 402 and sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.9 * len(held)
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == 402 and toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert {w for a, z in toxicity.windows(200) for w in range(a, z)} == set(range(200))


def test_tokenizer_by_words():
    from tokenizers import Tokenizer

    t, ours = Tokenizer.from_file(tokenizer_path()), packing.tokenizer(tokenizer_path())
    rng = random.Random(8)
    spaces = [chr(c) for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000)]
    some = ["It's", "''s", "'tis", "ß²½ªµ", "Naïve-Été", "a1b2!?", "<|endoftext|>", "İŞ", "Σς", "é", "́", "漢字かな", "12ab", "🙂🙂", "...!!", "we'LL", "​", "x" * 300]
    texts = ["", "  ", *("".join(rng.choice(some + spaces * 2) for _ in range(40)) for _ in range(300))]
    assert [np.frombuffer(b, "<u4").tolist() for b in ours.ids(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 41) for _ in range(400)]
    counts = {k: lengths.count(k) for k in set(lengths)}
    patterns = packing.plan(counts, 40)
    used: dict[int, int] = {}
    for n, items in patterns:
        assert n > 0 and sum(items) <= 40
        for k in items:
            used[k] = used.get(k, 0) + n
    assert used == counts
    assert sum(n for n, _ in patterns) <= -(-sum(lengths) // 40) * 1.05 + 1


def test_pack(spark, docs, empty):
    got = packing.pack(docs, tokenizer_path(), max_tokens=64).collect()
    t = packing.tokenizer(tokenizer_path())
    want = []
    for r in corpus():
        ids = next(t.ids([r[1] or ""])) + np.array([1], "<u4").tobytes()
        want += [(r[0], k, a // 4, len(ids[a : a + 256]) // 4, zlib.crc32(ids[a : a + 256])) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty, tokenizer_path()).count() == 0


def brute_groups(rows, words, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(rb"[ \t-\r]+", (t or "").encode().lower()) if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if sets[i] and ids else d))
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_similar_groups(spark, docs, empty, words, percent):
    got = sorted(map(tuple, jaccard.similar_groups(docs, words, percent).collect()), key=repr)
    assert got == sorted(brute_groups([(r[0], r[1]) for r in corpus()], words, percent), key=repr)
    if words == 5:
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns and jaccard.similar_groups(empty).count() == 0


def test_similar_random(spark):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_groups(df, 2, 80).collect())) == sorted(brute_groups(rows, 2, 80))


@pytest.mark.parametrize("size", [2, 7, 60])
def test_similar_in_cells(spark, monkeypatch, size):
    """Blocks larger than a cell: with a component that has nearly all of one, and with many small ones."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", size)
    rng = random.Random(size)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{k}" for k in range(4 + g % 3)]
        for _ in range(30 if g == 0 else 3):
            w = passage + own
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((1, 85), (2, 80), (1, 93)):
        assert sorted(map(tuple, jaccard.similar_groups(df, words, percent).collect())) == sorted(brute_groups(rows, words, percent))


def test_keep_one(spark, docs, empty):
    """One row of each group stays, with all its columns; ids that several texts share don't matter."""
    assert jaccard.keep_one(empty).count() == 0 and jaccard.keep_one(empty).columns == empty.columns
    rng = random.Random(11)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(4)]
    near = [t.rsplit(" ", 1)[0] + " other" for t in long]
    rows = [
        (1, long[0], 1, "a"), (2, near[0], 2, "a"), (5, long[1], 3, "a"), (5, long[2], 4, "a"), (5, near[2], 5, "a"),  # one id, two groups
        (6, near[1], 6, "a"), (7, long[3], 7, "a"), (7, long[3], 8, "b"), (8, "", 9, "a"), (8, "", 10, "a"), (9, None, 11, "a"), (None, long[0], 12, "a"), (None, "of no one " * 9, 13, "a"),
    ]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, one int, `row.a` string"))
    assert kept.columns == ["doc_id", "text", "one", "row.a"]
    got = sorted(r[2] for r in kept.collect())
    assert [k for k in got if k not in (4, 5)] == [1, 3, 7, 9, 10, 11, 13] and len(got) == 8
    groups = {(r.doc_id, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert groups == {(1, 1), (2, 1), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (None, 1), (None, None)}


def test_deduplicate_columns(spark):
    rows = [(1, "a", 5, "x"), (1, "a", 4, "y"), (2, "a", 3, "z"), (2, "a", 9, "z"), (3, "b", 1, None), (3, "c", 2, None), (None, "d", 1, None)]
    kept = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, __sha_of int, `a.b` string").repartition(5))
    assert kept.columns == ["doc_id", "text", "__sha_of", "a.b"]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(2, "a", 3, "z"), (3, "b", 1, None), (3, "c", 2, None), (None, "d", 1, None)], key=repr)


def test_decontaminate_rows(spark, empty):
    item = "a benchmark question of some length about rivers"
    docs = spark.createDataFrame([(1, "x " + item, 1), (1, "clean words", 2), (None, item, 3), (None, None, 4)], "doc_id long, text string, leak int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.leak for r in kept.collect()) == [2, 4]
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.decontaminate(docs, bench.limit(0)).count() == 4


def test_keep_quality(spark):
    docs, labels = labelled(spark, lambda w, r: w.upper() + "!!", "quality")
    docs = docs.withColumn("__score", F.col("doc_id") * 2)
    kept = quality.keep_quality(docs, labels)
    want = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.score >= quality.THRESHOLD}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and all(r["__score"] == 2 * r.doc_id for r in kept.collect())
    assert quality.keep_quality(docs.limit(0), labels).count() == 0


def test_trees_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 4))
    trees = quality.fit(x, (x[:, 0] + 0.3 * x[:, 2] > 0).astype(float), trees=12, depth=3)
    for row, got in zip(x, trees.score(x), strict=True):
        total = trees.base
        for root in trees.roots:
            at = root
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_very_long_texts(spark):
    """Half a million words in a row, beside short ones."""
    long = "calm river " * 250_000
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, long + "vileman")], "doc_id long, text string")
    bad, labels = labelled(spark, lambda w, r: r.choice([w, "vileman"]), "toxic")
    assert toxicity.score_toxicity(docs.unionByName(bad.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10)), labels.withColumn("doc_id", F.col("doc_id") + 10)).where("doc_id < 10").count() == 3
    assert quality.score_quality(docs, labels.withColumnRenamed("toxic", "quality")).count() == 3
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(turns)).first()
    assert got.loss_chars == len(long) and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got.valid


def test_bounded_memories():
    """Words and sets that are forgotten and met again give the same results."""
    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(300)}" for _ in range(50)) for _ in range(40)]
    small, large = packing.WordTokenizer(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    small.remembered = 20
    assert [b for t in texts for b in small.ids([t])] == list(large.ids(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([t.encode() for t in texts * 2]), pa.array(range(80))], names=["doc_id", "text", "text_hash"])
    one, many = (list(jaccard.set_rows([batch], 4, 85, n))[0].to_pydict() for n in (3, 1000))
    assert one["digest"] == many["digest"] and sum(e is not None for e in one["e"]) > sum(e is not None for e in many["e"]) == 40


def naive_plan(lengths: list[int], capacity: int) -> int:
    """Best-two-fit, one document at a time: the number of bins."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        bins += 1
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                gap -= x
                left.remove(x)
        while gap and bin_:
            least = min(bin_)
            room = gap + least
            left.append(least)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for j, b in enumerate(left) if i < j and least < a + b <= room]
            left.remove(least)
            pairs = [p for p in pairs]
            if not pairs:
                break
            _, a, b = max(pairs)
            bin_.remove(least)
            left.append(least)
            left.remove(a)
            left.remove(b)
            bin_ += [a, b]
            gap = capacity - sum(bin_)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_naive(seed):
    rng = random.Random(seed + 100)
    lengths = [rng.choice((rng.randrange(1, 31), rng.randrange(12, 20))) for _ in range(120)]
    bins = sum(n for n, _ in packing.plan({k: lengths.count(k) for k in set(lengths)}, 30))
    assert -(-sum(lengths) // 30) <= bins <= naive_plan(lengths, 30) + 1


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on the rows its predecessor kept, and run() against the stages."""
    import corpus_pipeline

    docs, labels = labelled(spark, lambda w, r: w.upper() + "!!", "quality")
    rng = random.Random(21)
    item = "which of the seven rivers of the plain is the longest one"
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    good = [t for k, t in texts if k is not None and k < 400 and k % 3 and len(t.split()) > 60]
    texts += [(500, good[0]), (501, good[0]), (502, " ".join(good[1].split()[:-1] + ["end"])), (503, good[2] + " " + item), (504, good[3][:200] + " " + item.replace("seven", "sevn"))]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = ([(r.doc_id, r.text) for r in at.collect()], out)
        if name != "packing":
            assert out.columns == at.columns
        at = out
    ids = lambda name: sorted(r.doc_id for r in kept[name][1].collect())
    before, out = kept["quality"]
    scores = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(before, "doc_id long, text string"), labels).collect()}
    assert ids("quality") == sorted(d for d, _ in before if scores[d] >= quality.THRESHOLD) and len(ids("quality")) < len(before)
    before, out = kept["exact_dedup"]
    assert ids("exact_dedup") == sorted(max(d for d, x in before if (x or "") == t) for t in {x or "" for _, x in before})
    before, out = kept["near_dedup"]
    groups = brute_groups(before, 5, 80)
    assert ids("near_dedup") == sorted(d for d, _, c in groups if d == c) and 502 not in ids("near_dedup")
    before, out = kept["decontamination"]
    budget = int(decontaminate.EDIT_SHARE * len(decontaminate.normalise(item)))
    assert ids("decontamination") == sorted(d for d, t in before if brute_distance(decontaminate.normalise(item), decontaminate.normalise(t or "")) > budget)
    assert not {503, 504} & set(ids("decontamination"))
    before, out = kept["packing"]
    t = packing.tokenizer(tokenizer_path())
    assert sorted((r.doc_id, r.ids_crc32) for r in out.collect()) == sorted((d, zlib.crc32(next(t.ids([x or ""])) + np.array([1], "<u4").tobytes())) for d, x in before)
    pieces = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(out)
    nothing = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name


def test_chat(spark):
    rows = [(1, 0, "system", "be [INST] kind\\"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "fine\n<\\s>"), (2, 0, "assistant", "first"), (2, 0, "assistant", "again"), (3, 0, None, None), (4, 1, "tool[AS]", "[AS]x"), (4, 2, "user", None), (None, 0, "user", "u")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, segment int")
    segments = chat.format_conversations(df).withColumn("extra", F.lit(1)).repartition(5, "seg_no")  # as a stored table has them
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[1].valid and not got[2].valid and not got[3].valid
    texts = [r.segment for r in segments.where("kind = 'text'").collect()]
    assert not any(s in x for x in texts for s in chat.Template().control)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
