"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from loomgraph.llm import blocks, compaction, components, decontaminate, jaccard, language, language_model, near_vectors, packing, token_counts, token_files, tokens, toxicity
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, score double, class string, part int, n_tokens string"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def twins(size=10):
    """Two different sequences of 2^size letters whose sums with powers of any base are equal modulo 2^64 from size 10 on."""
    one = "a"
    for _ in range(size):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    out = [None, "", " \n\t ", "one", "One", "two words", "!!! ...", "Ünï “quoted” don't 12³ <|endoftext|>", "中文 text 😀", " ".join(rng.choice(words, 20_000))]
    for b in base:
        w = b.split()
        out += [b, b, b.upper()]  # equal sets
        for _ in range(12):
            x = list(w)
            for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
                x[at] = f"x{rng.integers(1 << 30)}"
            out.append(" ".join(x))
    out += [*twins(), *(" ".join(["x", w, "y"] * 5) for w in twins(11)), *(" ".join(w) for w in twins(11))]
    hot = " ".join(f"h{k}" for k in range(50))
    out += [hot + " " + " ".join(rng.choice(words, 12)) for _ in range(60)]  # a passage that many share
    out += [hot + f" tail{k}" for k in range(40)]  # and near copies of it
    return out


@pytest.fixture(scope="module")
def rows():
    made = [(k, t, "en" if k % 2 else "fr", "s", 1.0, "x", 1, "y") for k, t in enumerate(texts())]
    return [*made, made[5], (None, "no id here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# --- shared pieces


def test_components(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (9, 1), (7, 8), (4, 4)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(links).collect()} == {1: 1, 3: 1, 5: 1, 9: 1, 7: 7, 8: 7}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["component"] for r in components.components(chain).collect()} == {0}
    assert components.components(links.where("false")).count() == 0


def test_packed_integers():
    for x in (np.array([], np.uint64), np.array([0, 1, 2**63], np.uint64), np.arange(1000, dtype=np.uint32)):
        assert (blocks.spread(blocks.squeeze(x), x.dtype) == x).all()


def test_hashes_of_structured_spans_differ():
    for size in (3, 6, 9, 10, 12):
        a, b = twins(size)
        data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
        _, _, _, h = blocks.word_hashes(data, np.array([0, len(data)]))
        assert h[0] == h[2] != h[1]
        _, _, _, h = blocks.word_hashes(np.frombuffer(" ".join(a + b).encode(), np.uint8), np.array([0, 2 * len(a + b) - 1]))
        same = next(k for k in range(len(a)) if a[k] != b[k])
        assert decontaminate._Spans(h).common(np.array([0, 0]), np.array([len(a), 0]), np.array([len(a), 5])).tolist() == [same, 5]
    every = [bytes([65 + k]) * n for k in range(5) for n in range(1, 200)]
    ends = np.cumsum([len(x) for x in every])
    h = blocks.span_hashes(np.frombuffer(b"".join(every), np.uint8), ends - [len(x) for x in every], ends)
    assert len(set(h.tolist())) == len(every)


def test_word_boundaries():
    data = np.frombuffer(b"ab c d", np.uint8)
    starts, ends, first = blocks.words(data, np.array([0, 1, 1, 6]), blocks.NOT_SPACE)
    assert starts.tolist() == [0, 1, 3, 5] and ends.tolist() == [1, 2, 4, 6] and first.tolist() == [0, 1, 1, 4]


# --- 1 and 5


def toxic_set():
    rng = np.random.default_rng(2)
    words = [f"plain{k}" for k in range(300)]
    out = []
    for k in range(400):
        t = list(rng.choice(words, 25))
        if k % 4 == 0:
            for at in rng.choice(25, 3, replace=False):
                t[at] = str(rng.choice(["nasty", "vile", "nastiest"]))
        out.append((k, " ".join(t), int(k % 4 == 0)))
    return out


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    u, begins = rng.normal(size=9), np.array([1, 0, 0, 0, 1, 0, 1, 0, 0], bool)
    t, s = rng.normal(size=(2, 2)), rng.normal(size=2)
    p, _, _ = toxicity.marginals(u, begins, t, s)
    for a, b in ((0, 4), (4, 6), (6, 9)):
        total, one = 0.0, np.zeros(b - a)
        for z in np.ndindex(*(2,) * (b - a)):
            w = math.exp(s[z[0]] + sum(u[a + k] * z[k] for k in range(b - a)) + sum(t[z[k - 1], z[k]] for k in range(1, b - a)))
            total += w
            one += w * np.array(z)
        assert p[a:b] == pytest.approx(one / total)


def test_toxicity(spark, docs, none):
    made = toxic_set()
    train = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in made] + [(None, 1, 1), (9999, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train(train, labels)
    got = by_id(toxicity.score(train, model))
    held = [(k, y) for k, _, y in made if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["predicted"] == y for k, y in held]) > 0.95
    k, text, _ = made[0]
    marked = {text[s["start"] : s["end"]] for s in got[k]["spans"]}
    assert marked and marked <= {"nasty", "vile", "nastiest"}
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(train, labels.where("toxic = 0")) is None
    assert {r["predicted"] for r in toxicity.score(train, None).collect()} == {0}
    kept = toxicity.keep_clean(train.withColumn("score", F.lit("mine")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["predicted"]}


def test_language(spark, docs, none):
    rng = np.random.default_rng(1)
    letters = {"en": "thaeonwy", "de": "schünäer", "fr": "éauxoiel", "es": "ñociónad"}
    made = [(4 * k + j, " ".join("".join(rng.choice(list(a), 5)) for _ in range(30)), lang) for k in range(60) for j, (lang, a) in enumerate(letters.items())]
    train = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(train)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    got = by_id(language.identify(train, model))
    held = [(k, y) for k, _, y in made if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["lang_pred"] == y for k, y in held]) > 0.95
    edge = by_id(language.identify(docs, model))
    assert [edge[k]["lang_pred"] for k in (0, 1, 2, 6)] == ["und"] * 4 and edge[0]["score"] == 0 and edge[8]["lang_pred"] != "und"
    assert language.identify(none, model).count() == 0
    blank = language.train(none)
    assert {r["lang_pred"] for r in language.identify(docs, blank).collect()} == {"und"}
    assert language.keep_identified(docs, model).count() == docs.count() - 4


# --- 2


def _plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def test_decontamination(spark, docs, rows, none):
    own = [t for _, t, *_ in rows if t]
    items = [("b", own[9][4000:4200]), ("a", own[20]), ("a", "nothing like it"), ("short", "Two, WORDS"), ("empty", "!!!"), ("null", None), (None, own[25]), ("twin", " ".join(["x", twins(11)[0], "y"] * 5))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {}
    for k, text, *_ in rows:
        w = _plain_words(text)
        hit, found = set(), set()
        for item, t in items:
            b = _plain_words(t)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(item or "")
        want[k] = (len(w), len(hit), sorted(found))
    for block in (decontaminate.BLOCK_WORDS, 1):  # all at once, and an item a block
        got = by_id(decontaminate.find_matches(docs, bench, block_words=block))
        assert {k: (r["n_words"], r["n_hit"], list(r["item_ids"])) for k, r in got.items()} == want
    assert any(m["n_words"] > 10 for m in got[rows[20][0]]["matches"] or []) or want[20][1] == 0
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, w in want.items() if not w[1]}
    assert decontaminate.find_matches(none, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_matches(docs, bench.where("false")).collect()} == {0}
    assert decontaminate.items_digest([]) == hashlib.sha256(b"").hexdigest()


# --- 3, 7, 10


@pytest.mark.parametrize(("name", "style"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(name, style):
    import random

    rnd = random.Random(4)
    safe = "ab'strevmlld''  \n\r\t12³½.,-’é ñÀÑ"
    cases = [t or "" for t in texts()] + ["".join(rnd.choice(safe if k % 3 else safe + "中Σσİ­\xa0́<|>") for _ in range(rnd.randint(0, 25))) for k in range(3000)]
    raw = [c.encode() for c in cases]
    enc = tokens.PretokenEncoder(public_tokenizers.path(name), style, cache=50)
    got = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    assert [g.tolist() for g in got] == [enc.tokenizer.encode(c, add_special_tokens=False).ids for c in cases]


def _ids(name, text, end):
    enc = tokens.encoder(public_tokenizers.path(name), "byte" if name.startswith("byte") else "word")
    return np.array([*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark, docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, blocks.shared_path(spark, "t"), path, "byte", 0, parts=3, block_bytes=3000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(spark, files).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for k, text, *_ in order:
        ids = _ids("byte_bpe_50k.json", text, 0)
        want.append((at, k, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert [x.tolist() for x in token_files.read_document(spark, files, 7)] == [_ids("byte_bpe_50k.json", rows[7][1], 0).tolist()]
    assert files.read(spark).select("dict_hash").distinct().count() == 1
    empty = token_files.write_token_files(none, blocks.shared_path(spark, "t"), path, "byte", 0)
    assert token_files.read_digests(spark, empty).count() == 0


def test_suffix_arrays_and_longest_matches():
    rng = np.random.default_rng(8)
    for trial in range(30):
        letters = [f"w{k}" for k in range(int(rng.integers(2, 6)))]
        items = [(f"i{k}", " ".join(rng.choice(letters, int(rng.integers(0, 30))))) for k in range(5)]
        docs = [list(rng.choice([*letters, "other"], int(rng.integers(0, 80)), p=[*[0.97 / len(letters)] * len(letters), 0.03])) for _ in range(8)] + [items[0][1].split()] * 3
        width = int(rng.integers(2, 6))
        test = decontaminate.test_suffixes(items, width)
        raw = [" ".join(w).encode() for w in docs]
        _, _, first, h = blocks.word_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64), blocks.ALNUM)
        found = {(int(np.searchsorted(first, p, side="right")) - 1, test.items[test.item[s]], int(p - first[np.searchsorted(first, p, side="right") - 1]), int(test.place[s]), int(n)) for p, s, n in zip(*decontaminate.search(test, h, first), strict=True)}
        want = set()
        for d, w in enumerate(docs):
            for name, text in items:
                b = text.split()
                for i in range(len(w)):
                    for j in range(len(b)):
                        n = 0
                        while i + n < len(w) and j + n < len(b) and w[i + n] == b[j + n]:
                            n += 1
                        if n >= min(width, len(b)) and not (i and j and w[i - 1] == b[j - 1]):
                            want.add((d, name, i, j, n))
        assert found == want
        ids = np.concatenate([*(np.append(rng.integers(1, 4, int(rng.integers(0, 40))), 0) for _ in range(6))])
        run = np.array([int(np.flatnonzero(ids[k:] == 0)[0]) for k in range(len(ids))])
        order, _ = decontaminate.suffix_array(ids, run, np.flatnonzero(ids), width, 100)
        assert order.tolist() == sorted(np.flatnonzero(ids).tolist(), key=lambda k: (ids[k : k + run[k]].tolist(), k))


def test_benchmark_blocks_are_bounded_by_words(spark):
    # words joined by hyphens are words too
    rows = [(f"i{k}", "-".join(f"w{k}x{j}" for j in range(50))) for k in range(6)]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    assert [len(b) for b in decontaminate._blocks_of(bench, "item_id", "text", 110)] == [2, 2, 2]
    docs = spark.createDataFrame([(1, "a " + rows[5][1].upper() + " b"), (2, rows[0][1][:40])], "doc_id long, text string")
    found = by_id(decontaminate.find_matches(docs, bench, block_words=60))
    assert found[1]["n_hit"] == 50 and found[1]["item_ids"] == ["i5"] and found[1]["matches"][0]["n_words"] == 50 and found[2]["n_hit"] == 0


def test_token_counts(docs, rows, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.count_tokens(docs, path, limit=10))
    for k, text, *_ in rows:
        n = len(model.encode(text or ""))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((text or "").encode()), n, n > 10)
    small = by_id(token_counts.count_tokens(docs, path, limit=10, block_bytes=300))
    assert {k: tuple(r) for k, r in small.items()} == {k: tuple(r) for k, r in got.items()}
    odd = ["", " ", "  a  b ", "▁a▁", "\n\na", "<s>x</s>", "a\t b", "▁", None, "a" * 5000, " " * 300]
    more = docs.sparkSession.createDataFrame([(str(k), t, 1) for k, t in enumerate(odd)] + [(None, "a b", 2), ("0", "x", 3)], "name string, body string, n_tokens int")
    found = sorted(((r["doc_id"] or "~", r["n_tokens"]) for r in token_counts.count_tokens(more, path, "name", "body").collect()))
    assert found == sorted([(str(k), len(model.encode(t or ""))) for k, t in enumerate(odd)] + [("~", len(model.encode("a b"))), ("0", len(model.encode("x")))])
    assert token_counts.count_tokens(none, path).count() == 0


def test_each_distinct_pre_token_is_counted_once(spark, docs, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    stored, _ = blocks.stored(token_counts.frequency_blocks(docs, "doc_id", "text", block_bytes=300), "pre-tokens")
    asked = token_counts.piece_numbers(stored, path, 5).groupBy("deal").agg({"asked": "max"}).collect()
    distinct = {w for _, t, *_ in rows for w in re.findall(" *[^ ]+| +", " " + t.replace("▁", " ") if t else "")}
    assert stored.count() > 3 and sum(r["max(asked)"] for r in asked) == len(distinct)


def test_packing(docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, "word", 1, capacity=512).collect()
    want = collections.Counter()
    for k, text, *_ in rows:
        ids = _ids("word_bpe_49k.json", text, 1)
        for p, at in enumerate(range(0, len(ids), 512)):
            want[(k, p, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 512
    gaps: list[int] = []  # first fit, longest first
    for n in sorted((r["length"] for r in got), reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= n), None)
        if k is None:
            gaps.append(512 - n)
        else:
            gaps[k] -= n
    assert len(bins) <= len(gaps)
    assert packing.pack(none, path, "word", 1).count() == 0


def test_best_two_fit_replaces_the_shortest():
    # greedy takes 6 and 3; 3 gives way to 2 + 2, which fill the gap of 4
    number, offset = packing.pack_lengths(np.array([6, 3, 2, 2]), 10)
    assert number[0] == number[2] == number[3] != number[1] and sorted(offset[[0, 2, 3]].tolist()) == [0, 6, 8]


# --- 4


def test_compaction(spark, docs, none):
    root = blocks.shared_path(spark, "shards")
    back = compaction.compacted(docs, root, arrivals=3, target=1 << 16, least=1 << 10)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect())) and back.columns == docs.columns
    store = compaction.ShardStore(spark, root, target=1 << 16, least=1 << 10)
    assert not store.plan(store.shards())
    before = store.version()
    assert store.append(none) == before + 1 and store.read(before).count() == docs.count()
    with pytest.raises(compaction.CommitConflict):
        store._commit([], [], none.schema.json(), before)
    assert compaction.compacted(none, blocks.shared_path(spark, "shards")).count() == 0


def test_compaction_with_two_writers(spark, docs, monkeypatch):
    root = blocks.shared_path(spark, "shards")
    one, two = (compaction.ShardStore(spark, root, target=1 << 16, least=1 << 10) for _ in range(2))
    part = docs.limit(40).cache()
    one.append(part)
    # the other writer commits between the look at the newest version and the commit: the arrival takes the next turn
    commit, raced = one._commit, []

    def late(new, gone, schema, after):
        if not raced:
            raced.append(two.append(part))
        return commit(new, gone, schema, after)

    monkeypatch.setattr(one, "_commit", late)
    one.append(part)
    assert one.read().count() == 3 * part.count()
    # a merge whose shards another writer has taken is given up, and leaves no file
    gone = one.shards()[:1]
    two._commit([], gone, part.schema.json(), two.version())
    left = one.read().count()
    assert one._commit_merge([], gone, part.schema.json()) is None and one.read().count() == left < 3 * part.count()
    # files written and not yet committed outlive a vacuum with a grace period, and a crash before the commit changes no version
    folder = f"{root}/shards/other"
    part.write.parquet(folder)
    version = two.version()
    two.vacuum()
    assert one._commit_new(one._written(folder), part.schema.json()) == version + 1
    assert two.read().count() == left + part.count() and one.read(version).count() == left
    part.write.parquet(f"{root}/shards/crashed")
    assert two.vacuum(grace=0) > 0 and two.read().count() == left + part.count()


def test_versions_from_snapshots_and_steps(spark, docs):
    store = compaction.ShardStore(spark, blocks.shared_path(spark, "shards"), target=1 << 22, least=1 << 10, fanout=3)
    part = docs.limit(3).coalesce(1).cache()
    sizes = []
    for k in range(14):
        store.append(part)
        sizes.append((store.version(), 3 * (k + 1)))
    assert store.version() > compaction.SNAPSHOT and all(store.read(v).count() == n for v, n in sizes[::4])
    assert not store.plan(store.shards()) and len(store.shards()) < 9
    store.vacuum(grace=0)
    assert store.read().count() == 42


# --- 6


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16))
    rows = [(k, v.astype(float).tolist(), k % 3) for k, v in enumerate(x)]
    for k in range(60):  # near copies of a few, and a large group of one
        v = x[k % 4 if k < 20 else 0]
        rows.append((100 + k, (v + rng.normal(size=16) * 0.03 * np.linalg.norm(v)).tolist(), (k % 4 if k < 20 else 0) % 3))
    rows += [(300 + k, x[1].tolist(), 1) for k in range(5)] + [(400, (2 * x[1]).tolist(), 1)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, x[1].tolist(), None), (505, [], 1), (506, [1.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, class string")
    links, root = collections.Counter(), {k: k for k, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    good = [(k, np.array(v) / np.linalg.norm(v), y) for k, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for i, (a, v, y) in enumerate(good):
        for b, w, z in good[i + 1 :]:
            if y == z and len(v) == len(w) and float(v @ w) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    for block in (512, 8):  # one cell a bucket, and buckets cut into blocks
        got = {r["vec_id"]: r for r in near_vectors.near_components(table, block=block).collect()}
        assert len(got) == len(rows) and all(got[k]["n_links"] <= links[k] for k in got)
        assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(links.values())
        assert np.mean([got[k]["component_id"] == find(k) for k in got]) > 0.95
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert near_vectors.near_components(table.where("false")).count() == 0
    # the same vectors in single precision, and a link at recall 1: copies up to a factor
    single = table.where("vec_id < 500").withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = {r["vec_id"]: r for r in near_vectors.near_components(single).collect()}
    assert {got[k]["component_id"] for k in (1, 300, 301, 302, 303, 304, 400)} == {got[1]["component_id"]}
    assert np.mean([got[k]["component_id"] == find(k) for k in got]) > 0.95


# --- 8


def test_language_model(spark, docs, rows, none):
    got = by_id(language_model.interpolated_scores(docs, block_bytes=2000))
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + ["\0end"]) for k, t, *_ in rows]
    fold = {k: zlib.crc32(str(k).encode()) % 7 if k is not None else None for k, _ in words}
    c = collections.Counter(x for k, w in words if fold[k] not in (2, None) for x in w)
    n, v = sum(c.values()), len(c)
    for k, w in words:
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[k] == 2, len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert language_model.interpolated_scores(none).count() == 0
    one = language_model.interpolated_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert one["train_tokens"] == 0 and one["base_score"] == 0 and one["score"] == pytest.approx(0)


def test_language_model_score_equals_plain_interpolation(docs, rows):
    words = [(zlib.crc32(str(k).encode()) % 7 if k is not None else None, k, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + ["\0end"]) for k, t, *_ in rows]
    # counts of all training documents, and of the part deleted for the weights
    one, two, one_out, two_out = (collections.Counter() for _ in range(4))
    for fold, _, w in words:
        if fold in (2, None):
            continue
        for counts1, counts2 in [(one, two)] + [(one_out, two_out)] * (fold == 3):
            counts1.update(["\0start", *w])
            counts2.update(zip(["\0start", *w], w, strict=False))
    n = sum(c for x, c in one.items() if x != "\0start")
    n_out = sum(c for x, c in one_out.items() if x != "\0start")
    v = len(one) - 1

    def bucket(c):
        return min(c.bit_length(), 23)

    parts = collections.defaultdict(list)
    for fold, _, w in words:
        if fold == 3:
            for h, x in zip(["\0start", *w], w, strict=False):
                left = one[h] - one_out[h]
                parts[bucket(left)].append(((two[h, x] - two_out[h, x]) / left if left else 0.0, (one[x] - one_out[x]) / (n - n_out), 1 / (v + 1)))
    weights = collections.defaultdict(lambda: np.array(language_model.PRIOR))
    for b, seen in parts.items():
        r, w = np.array(seen), np.array(language_model.PRIOR)
        for _ in range(100):
            share = w * r / (r @ w)[:, None]
            w = share.sum(axis=0) + 0.5 * np.array(language_model.PRIOR)
            w /= w.sum()
        weights[b] = w
    want = {}
    for _, k, w in words:
        total = 0.0
        for h, x in zip(["\0start", *w], w, strict=False):
            g = weights[bucket(one[h])]
            p = g @ [two[h, x] / one[h] if one[h] else 0.0, one[x] / n, 1 / (v + 1)]
            total += math.log10(p / (1 if one[h] else g[1] + g[2]))
        want[k] = total
    got = by_id(language_model.interpolated_scores(docs, block_bytes=2000))
    for k, x in want.items():  # the operator keeps ratios by half doublings, so weights differ a little
        assert got[k]["score"] == pytest.approx(x, rel=0.01, abs=0.01), k


def test_weights_find_the_mixture():
    # tokens that only the bigram explains, in the first bucket
    w = language_model.learn_weights([(1 << 16, 100.0, 100 * 50.0, 100 * 0.5)])
    assert w[1, 0] > 0.95 and w[2].tolist() == list(language_model.PRIOR)


# --- 9


def test_jaccard(docs, rows, none, monkeypatch):
    sets = []
    for k, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append((k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    want = {k: (len(s), least.get(find(i), None)) for i, (k, s) in enumerate(sets)}
    for hot in (16, 3):  # few and many hot parts
        monkeypatch.setattr(jaccard, "HOT", hot)
        got = by_id(jaccard.jaccard_components(docs))
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in want.items() if k == c}
    assert jaccard.jaccard_components(none).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.93], rng.integers(0, 2**64, int(0.05 * len(a)), dtype=np.uint64))))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= 75 * (len(a) + len(b) - same):
            ka, _, sa = jaccard.sketch_parts(a, np.array([0, len(a)]))
            kb, _, sb = jaccard.sketch_parts(b, np.array([0, len(b)]))
            shared = np.intersect1d(ka, kb)
            slot = (shared >> np.uint64(jaccard.DROP)) & np.uint64(jaccard.SLOTS - 1)
            assert any((slot == k).sum() >= max(sa[k, 0], sb[k, 0]) >= 1 and jaccard._NONE not in (sa[k, 0], sb[k, 0]) for k in range(jaccard.SLOTS))
            wide = max(map(jaccard.sketch_bits, (len(a), len(b))))
            pa, pb = jaccard.dense_sketch(a, wide), jaccard.dense_sketch(b, wide)
            half = jaccard.fold(pa, len(pa) // 2)
            assert (half == jaccard.dense_sketch(a, wide // 2)).all()
            assert int(np.bitwise_count(half ^ jaccard.fold(pb, len(half))).sum()) <= int(np.bitwise_count(pa ^ pb).sum()) <= len(a) + len(b) - 2 * same


def test_every_small_size_has_parts_to_spare():
    rng = np.random.default_rng(3)
    for n in [*range(1, 200), 300, 383, 384, 500, 767, 768, 1500]:
        for _ in range(40 if n < 65 else 4):
            # the larger set has n shingles; as many as may be are left out, then as many as may be are exchanged
            b = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            for kept, extra in ((-(-3 * n // 4), 0), (-(-6 * n // 7), n - -(-6 * n // 7))):
                a = np.sort(np.concatenate((b[rng.permutation(n)[:kept]], rng.integers(0, 2**64, extra, dtype=np.uint64))))
                assert 100 * kept >= 75 * (len(a) + n - kept)
                ka, _, sa = jaccard.sketch_parts(a, np.array([0, len(a)]))
                kb, _, sb = jaccard.sketch_parts(b, np.array([0, n]))
                shared = np.intersect1d(ka, kb)
                slot = (shared >> np.uint64(jaccard.DROP)) & np.uint64(jaccard.SLOTS - 1)
                assert any((slot == k).sum() >= max(sa[k, 0], sb[k, 0], 1) and jaccard._NONE not in (sa[k, 0], sb[k, 0]) for k in range(jaccard.SLOTS))


def test_jaccard_of_sets_without_spare_parts(spark):
    # in a sketch with two parts a shingle, shingles of these sets fall into one part
    a = "w745546905 w245282770 w697832818 w934287682 w825058394 w834945434 w53373944"
    rng = np.random.default_rng(4)
    rows = [(1, a), (2, a + " w882760860")]
    for k in range(3, 603, 2):
        t = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 7))
        rows += [(k, t), (k + 1, t + f" w{rng.integers(0, 10**9)}")]
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r["component_id"] for k, r in got.items()} == {k: k - (k % 2 == 0) for k, _ in rows}


def test_jaccard_of_crowded_groups(spark, monkeypatch):
    # many variants of one text, most of them no copies of each other, and chains among them
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(260):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 8)), replace=False):
            w[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(260))
    for _ in range(260):
        before = list(least)
        for i in range(260):
            for j in range(i):
                if least[i] != least[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    p, q = sorted((least[i], least[j]))
                    least = [p if x == q else x for x in least]
        if before == least:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 20)
    for hot in (16, 4):
        monkeypatch.setattr(jaccard, "HOT", hot)
        got = by_id(jaccard.jaccard_components(docs))
        assert [got[k]["component_id"] for k in range(260)] == least
