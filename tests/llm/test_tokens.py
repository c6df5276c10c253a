"""Token files, BPE and token counts against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedback_spark.llm import huffman_files, merge_tree, piece_counts, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    rng = random.Random(7)
    pool = [*map(chr, range(0x20, 0x180)), "\n", "\t", "\x1c", "\x85", " ", "'s", "'T", "<|endoftext|>", "<|", "Σ", "İ", "́", "가", "漢", "😀", "  "]
    return ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(n)] + ["a" * 5000, "ab" * 999, ""]


def test_segment_tree_encodes_as_the_library(library):
    texts = odd_texts(1500)
    made = merge_tree.MergeTree(WORDS).encode(texts)
    assert [np.frombuffer(m, "<i4").tolist() for m in made] == [ids_of(library, t) for t in texts]


def test_library_encoder_on_distinct_words(library):
    texts = odd_texts(500)
    made = huffman_files.LibraryEncoder(WORDS).encode(texts)
    assert [np.frombuffer(m, "<u2").tolist() for m in made] == [ids_of(library, t) for t in texts]


def test_both_encoders_know_every_code_point(library):
    """Also those that this Python's Unicode tables do not know."""
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(m, "<u2").tolist() for m in huffman_files.LibraryEncoder(WORDS).encode(texts)] == want
    odd = [i for i, t in enumerate(texts) if not t.isprintable()]
    made = merge_tree.MergeTree(WORDS).encode([texts[i] for i in odd])
    assert [np.frombuffer(m, "<i4").tolist() for m in made] == [want[i] for i in odd]


def test_merge_takes_the_leftmost_lowest_rank():
    tree = merge_tree.MergeTree(WORDS)
    v = tree.vocabulary
    rank = {p: i for i, p in enumerate(v.merges)}

    def plain(word):
        parts = [v.letters[b] for b in word.encode()]
        parts[-1] += v.suffix
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                return [v.ids[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    words = ["a", "aaaaaaa", "international", "ererererer", "ß", "mississippi", "xqzj" * 40]
    assert [np.frombuffer(m, "<i4").tolist() for m in tree.encode_pre_tokens(words)] == [plain(w) for w in words]


def test_encode_and_decode_frames(docs, no_docs, library):
    made = merge_tree.decode(merge_tree.encode(docs, WORDS), WORDS)
    rows = made.collect()
    assert made.columns == ["doc_id", "text", "lang", "source", "ids", "decoded"] and len(rows) == docs.count()
    for r in rows:
        assert r.ids == ids_of(library, r.text)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert merge_tree.decode(merge_tree.encode(no_docs, WORDS), WORDS).count() == 0


def test_decode_of_null_and_unknown_ids(frame):
    rows = merge_tree.decode(frame("ids array<int>", (None,), ([],), ([1, None, 10**6],)), WORDS).collect()
    assert [r.decoded for r in rows] == ["", "", '"']


def test_merge_tree_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_merge_tree"](spark, SMALL).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    for n in (2, 3, 9, 60, 400):
        counts = rng.integers(0, 90, n)
        counts[:2] += 1
        lengths = huffman_files.code_lengths(counts)
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1 and not lengths[counts == 0].any()
        assert (lengths * counts).sum() == huffman_cost(counts)
    skewed = huffman_files.code_lengths(2 ** np.arange(30))
    assert skewed.max() == huffman_files.MOST_BITS
    assert huffman_files.code_lengths(np.array([0, 5])).tolist() == [0, 1]
    assert not huffman_files.code_lengths(np.zeros(4)).any()


def huffman_cost(counts):
    import heapq

    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_blocks_decode_from_checkpoints():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.geometric(0.01, 5000) - 1, 999)
    lengths = huffman_files.code_lengths(np.bincount(ids, minlength=1000))
    payload, at = huffman_files.pack(ids, huffman_files.canonical_codes(lengths), lengths)
    assert len(payload) == -(-int(lengths[ids].sum()) // 8)
    back = huffman_files.Decoder(lengths).block(payload, at[:: huffman_files.STEP], len(ids))
    assert back.tolist() == ids.tolist()


def test_token_files_round_trip(docs, no_docs, library, monkeypatch):
    monkeypatch.setattr(huffman_files, "BLOCK_IDS", 50)
    rows = huffman_files.round_trip(docs, WORDS).orderBy("start").collect()
    given = docs.collect()
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in given), key=lambda x: (x is not None, x))
    texts = {r.doc_id: r.text for r in given}
    start = 0
    for r in rows:
        ids = [*ids_of(library, texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    assert huffman_files.round_trip(no_docs, WORDS).count() == 0


def test_token_files_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    made = queries.QUERIES["op1_token_files"](spark, SMALL).orderBy("doc_id").collect()
    start = 0
    for d, r in zip(docs, made, strict=True):
        ids = np.array([*ids_of(library, d.text), 2], "<u4")
        assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_of_pre_tokens_add_up():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    pool = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "漢", "<s>", "</s>", "<unk>", "<0x0A>", "the", "word", "\x00", " ", "　"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randrange(14)))
        cut = piece_counts.pre_tokens(text)
        assert sum(piece_counts.piece_numbers(PIECES, cut) if cut else []) == len(model.encode(text)), repr(text)


def test_token_counts(spark, docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(piece_counts, "CHUNK_DOCUMENTS", 3)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    key = lambda r: (r[0] is not None, r[0], r[1])
    made = sorted((tuple(r) for r in piece_counts.token_counts(stored, PIECES).collect()), key=key)
    wanted = sorted(((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()), key=key)
    assert made == wanted
    assert piece_counts.token_counts(no_docs, PIECES).count() == 0


def test_token_counts_read_the_table_once(spark, monkeypatch):
    """Rows that come in another order and other partitions whenever they are read, as after a lost executor."""
    monkeypatch.setattr(piece_counts, "CHUNK_DOCUMENTS", 4)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("one two "), F.col("id").cast("int") % 50).alias("text"))
    for shuffled in (many.repartition(7).orderBy(F.rand()), many.repartition(F.rand())):
        made = piece_counts.token_counts(shuffled, PIECES)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Range (") == 1 and "Join" not in plan
        wanted = {r.doc_id: (len(r.text), len(model.encode(r.text))) for r in many.collect()}
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in made.collect()} == wanted


def test_token_counts_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    made = queries.QUERIES["op6_piece_counts"](spark, SMALL).collect()
    assert len(made) == len(texts)
    for r in made:
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_words_are_kept_once_in_any_case():
    tree = merge_tree.MergeTree(WORDS)
    first, second = tree.encode(["Wort WORT wort, Wort,", "wort wort wort, wort,"])
    assert first == second and set(tree.kept) - set(tree.special) == {"wort", "wort,"}


def test_decoding_of_slices_equals_a_plain_join(frame):
    strings = merge_tree.MergeTree(WORDS).vocabulary.strings
    rows = [(i, [(7 * i + j) % len(strings) for j in range(i % 9)]) for i in range(1300)]
    made = merge_tree.decode(frame("doc_id long, ids array<int>", *rows).coalesce(1), WORDS).collect()
    assert {r.doc_id: r.decoded for r in made} == {i: " ".join(strings[x] for x in ids) for i, ids in rows}
