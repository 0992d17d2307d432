"""Token files, byte-level BPE and packing against the libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tradewind.llm import byte_bpe, packing, token_orc
from tradewind.llm.common import json_encoder, scratch

ODD = [
    None, "", " ", "  ", "\n", "\n\n\n a", "a  b   c", "tab\there\r\n", "it's we'll I'M 'S", "x" * 5000, "=" * 333, " " * 77, "aaaaa" * 40, "naïve café Ünïcödé", "ΑΣ ΟΔΟΣ Σ", "é ä́",
    "日本語のテキスト", "🙂👩‍👩‍👧 flags 🇩🇪", "١٢٣ ²½ Ⅷ", "a b c　d\u0085e", "a\x1cb\x1fc​d", "<|endoftext|> and <|startoftext|>", "foo_bar __init__ 3.14 1,000", "́start", " 'tis ' s", "İstanbul ǅ", "K Å",
]
ORDER = [5, -1, None]


def fuzz(n=250):
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "Σ", "1", "23", "!", "...", "日", " ", "́", "A", "WORD", "_", "==", "🙂", " ", "\x85", "İ"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_the_library_s(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [x or "" for x in ODD] + fuzz()
    counts, ids = json_encoder(path).encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, x in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def rank_reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_rank_codec_is_tiktoken_s():
    ref, c = rank_reference(), byte_bpe.codec(*RANKS)
    texts = [x or "" for x in ODD] + fuzz(400)
    counts, ids = c.encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, x in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == ref.encode_ordinary(x), repr(x)
    assert c.decode(counts, ids) == [x.encode() for x in texts]
    assert c.decode(np.array([3, 0]), np.array([-1, int(ids[0]), 10**6])) == [c.decode(np.array([1]), ids[:1])[0], b""]


def test_round_trip_encode_and_decode(spark):
    ref = rank_reference()
    docs = spark.createDataFrame([(i, x, "y") for i, x in enumerate(ODD)] + [(3, "again", "y"), (3, "again", "y"), (None, "no id", None)], "doc_id long, text string, ids string")
    got = sorted(map(tuple, byte_bpe.round_trip(docs, *RANKS).collect()), key=repr)
    want = sorted([(r.doc_id, len(e := ref.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect()], key=repr)
    assert got == want
    enc = byte_bpe.encode(docs, *RANKS)
    back = {r.doc_id: r.text for r in byte_bpe.decode(enc.filter("doc_id <> 3 or doc_id is null"), *RANKS).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(ODD) if i != 3)
    for r in enc.collect():
        x = "again" if r.doc_id == 3 and len(r.ids) == 1 else (ODD[r.doc_id] or "") if r.doc_id is not None else "no id"
        if r.doc_id != 3:
            assert (not r.ids and not x) or (r.starts[0] == 0 and r.ends[-1] == len(x) and all(a < b for a, b in zip(r.starts, r.ends)))
    assert byte_bpe.round_trip(docs.limit(0), *RANKS).count() == 0


def small(spark):
    return spark.createDataFrame([(i * 7 % 101, x, "s") for i, x in enumerate(ODD * 3)] + [(None, "no id", None)], "doc_id long, text string, shard string").repartition(5)


def test_token_files(spark):
    docs, path = small(spark), scratch(spark, "test")
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    token_orc.write_token_ids(docs, path, vocab, end_id=0)
    e = json_encoder(vocab)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start, want = 0, []
    for d, t in rows:
        ids = [*e.encode([t])[1].tolist(), 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_orc.token_spans(spark, path).collect()), key=lambda x: x[1])
    assert got == want
    one = token_orc.read_token_ids(spark, path).filter("doc_id = 7")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString() and one.count() == sum(d == 7 for d, _ in rows)
    empty = scratch(spark, "test")
    token_orc.write_token_ids(docs.limit(0), empty, vocab)
    assert token_orc.token_spans(spark, empty).count() == 0


def rows_read(df):
    """Rows that the scan gave out, after stripes and row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_readers_skip_by_index_and_bloom_filter(spark):
    """Ids are even: an odd one lies inside every statistic, and only the Bloom filter can tell that it isn't there."""
    path = scratch(spark, "test")
    docs = spark.range(40_000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text")
    token_orc.write_token_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    table = token_orc.read_token_ids(spark, path).select("doc_id", "n_tokens")
    stride = int(token_orc.OPTIONS["orc.row.index.stride"])
    assert 0 < rows_read(table.filter("doc_id = 44444")) <= stride
    assert sum(rows_read(table.filter(f"doc_id = {k}")) for k in (40_001, 44_445, 60_003, 79_997)) <= stride  # a false one in a hundred
    assert rows_read(table.filter("doc_id between 30000 and 30100")) <= 2 * stride
    assert rows_read(table.filter("doc_id >= 0")) == 40_000


def test_texts_beyond_python_s_tables_are_the_library_s():
    from tokenizers import Tokenizer

    codes = [*range(0x2E0, 0x600), 0x7FD, 0x898, 0x1C89, 0x1DF6, *range(0x1AB0, 0x1AD0), 0xA7CB, 0x105C0, 0x10EAB, 0x11938, 0x1E4EC, 0x1E4EF, 0x1FBF0, 0xB2, 0x2460, 0x2167]
    texts = [f"Ab{chr(c)}cD 1{chr(c)}2 {chr(c)} á{chr(c)}{chr(c)}\u0301\u0345\u0315 -{chr(c)}" for c in codes]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        counts, ids = json_encoder(path, added=True).encode(texts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i, want in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
            assert ids[ends[i] : ends[i + 1]].tolist() == want.ids, ascii(texts[i])


def test_a_pool_keeps_two_generations():
    from tradewind.llm.common import Pool, flat

    made = []

    def make(keys):
        made.extend(keys)
        return flat([[len(k)] * (int(k) % 3) for k in keys])

    pool = Pool(make, 10)
    r = random.Random(5)
    for _ in range(200):
        keys = [str(r.randrange(40)) for _ in range(r.randrange(8))]
        lens, ids = pool.take(keys)
        assert lens.tolist() == [int(k) % 3 for k in keys] and ids.tolist() == [len(k) for k in keys for _ in range(int(k) % 3)]
        assert len(pool.young.slots) <= 10 + 8 and len(pool.old.slots) <= 18
    assert len(made) < 700


def check_packing(rows, want, window):
    """rows: pieces; want: id lists. All ids in exactly one piece, sequences gapless, padding only up to a power of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids.tolist()))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(t for v in by_doc.values() for t in [sum(len(i) for _, i in v)]) is not None
    for (d, n), pieces in by_doc.items():
        if sum(len(i) for _, i in pieces) == n:  # ids that repeat can't be told apart
            assert [x for _, i in sorted(pieces) for x in i] == want[d]
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at == window or at & (at - 1) == 0 and at < window


def test_packing_whole(spark):
    vocab = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(1)
    texts = [*ODD, *(" ".join(r.choice(["alpha", "be", "c", "delta"]) for _ in range(r.randrange(1, 90))) for _ in range(300)), "long " * 9000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int").repartition(7)
    e = json_encoder(vocab)
    want = {i: [*e.encode([t or ""])[1].tolist(), 2] for i, t in enumerate(texts)}
    for window in (64, 4096):
        check_packing(packing.pack_documents(docs, vocab, 2, window).collect(), want, window)
    assert packing.pack_documents(docs.limit(0), vocab, 2).count() == 0


def test_plan_uses_whole_combinations():
    hist = np.zeros(64, np.int64)
    hist[[10, 20, 24, 34, 30, 44]] = [100, 50, 10, 60, 40, 7]
    plan = packing.make_plan(hist, 5, 64)
    seqs = {}
    for length in np.flatnonzero(hist):
        for nth in range(hist[length]):
            pieces = plan.tail(int(length), nth)
            assert sum(p[1] for p in pieces) == length
            for s, n, q, o in pieces:
                seqs.setdefault(q, []).append((o, n))
    assert min(seqs) == 5 and max(seqs) == 4 + len(seqs)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert plan.fitted.sum() > 0.6 * hist.sum()
    assert packing.solve([(1, 1, 2), (2, 2)], np.array([0, 4, 2])).round(3).tolist() == [2, 0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_the_library_s_ids(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    r = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|", " ", "  ", "\n", "é", "Σ", "the", "1", "end of part"]
    texts = [x or "" for x in ODD] + fuzz() + ["end of part <|endoftext|> next part"] + ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(300)]
    counts, ids = json_encoder(path, added=True).encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, x in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_queries_take_added_tokens(spark, monkeypatch):
    from tradewind.llm import queries

    text = "end of part <|endoftext|> next part"
    docs = spark.createDataFrame([(1, text), (2, "next")], "doc_id long, text string")
    monkeypatch.setattr(queries, "_table", lambda *a: docs)
    e = json_encoder(public_tokenizers.path("byte_bpe_50k.json"), added=True)
    ids = e.encode([text])[1].tolist()
    rows = {r.doc_id: r for r in queries.op1_token_ids_orc(spark, "").collect()}
    assert 50256 in ids and rows[1].n_tokens == len(ids) + 1 == rows[2].start
    ids = json_encoder(public_tokenizers.path("word_bpe_49k.json"), added=True).encode([text])[1].tolist()
    assert 49407 in ids and {r.doc_tokens for r in queries.op8_pack_nnls(spark, "").collect() if r.doc_id == 1} == {len(ids) + 1}
