"""A text longer than a slice, beside short ones, through every operator that cuts texts into slices."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from loomgraph.llm import blocks, decontaminate, jaccard, language, language_model, packing, token_counts, token_files, toxicity
from tokenizers import Tokenizer

from tests.llm.test_operators import toxic_set, twins


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(12)
    words = np.array([f"w{k}x" for k in range(3000)])
    long = " ".join(words[rng.integers(0, 3000, 420_000)])
    assert len(long) > blocks.SLICE_BYTES
    a, b = twins(11)
    return ["short one", long, "", " ".join(words[rng.integers(0, 3000, 50)]), f"{a} {b} " * 300, long[: 1 << 20] + " end"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_words_shingles_and_matches(spark, docs, texts):
    words = {k: t.split() for k, t in enumerate(texts)}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for k, w in words.items()}
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()} and {r["component_id"] for r in got.values()} == set(got)
    item = " ".join(words[1][200_000:200_050])
    bench = spark.createDataFrame([("a", item), ("b", " ".join(words[3][10:30]))], "item_id string, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in decontaminate.find_matches(docs, bench).collect()}
    assert found[1] == (420_000, 50, ["a"]) and found[3] == (50, 20, ["b"]) and found[5][1:] in ((0, []), (50, ["a"])) and found[4] == (600, 0, [])


def test_ids_and_counts_are_the_librarys(spark, docs, texts):
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: [*byte.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    files = token_files.write_token_files(docs, blocks.shared_path(spark, "long"), public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(spark, files).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for k, x in want.items()}
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {k: len(word.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r["sum(length)"] for r in pieces} == sizes
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert counts == {k: len(model.encode(t)) for k, t in enumerate(texts)}


def test_scores_of_whole_texts(spark, docs, texts):
    lm = {r["doc_id"]: r["n_tokens"] for r in language_model.interpolated_scores(docs).collect()}
    assert lm == {k: len(t.split()) + 1 for k, t in enumerate(texts)}
    made = toxic_set()
    model = toxicity.fit([t for _, t, _ in made], np.array([float(y) for _, _, y in made]), rounds=12)
    marked = spark.createDataFrame([(1, texts[1] + " vile nasty"), (2, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(marked, model).collect()}
    assert got[1]["score"] > got[2]["score"] and {(texts[1] + " vile nasty")[s["start"] : s["end"]] for s in got[1]["spans"]} >= {"vile", "nasty"}
    rng = np.random.default_rng(1)
    letters = {"en": list("thaeonwy"), "de": list("schünäer"), "fr": list("éauxoiel")}
    prose = lambda lang, n: " ".join("".join(rng.choice(letters[lang], 5)) for _ in range(n))
    known = spark.createDataFrame([(3 * k + j, prose(lang, 30), lang) for k in range(60) for j, lang in enumerate(letters)], "doc_id long, text string, lang string")
    long = {k: (prose(lang, 4000) + " ") * 100 for k, lang in enumerate(letters)}
    said = language.identify(spark.createDataFrame(list(long.items()), "doc_id long, text string"), language.train(known)).collect()
    assert min(len(t) for t in long.values()) > blocks.SLICE_BYTES and {r["doc_id"]: r["lang_pred"] for r in said} == dict(enumerate(letters))
