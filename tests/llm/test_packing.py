import random
import struct
import zlib

from tokenizers import Tokenizer

from logweave.llm.packing import first_fit, op6_packing, pack_documents, tokenizer_path

from .test_near_dedup import thue_morse
from .util import corpus, documents, prose


def test_first_fit_equals_a_plain_search():
    rng = random.Random(2)
    for size in (10, 64):
        lengths = sorted((rng.randrange(1, size + 1) for _ in range(200)), reverse=True)
        bins, offsets = first_fit(lengths, size)
        free = []
        for n, b, o in zip(lengths, bins, offsets):
            k = next((i for i, f in enumerate(free) if f >= n), len(free))
            free += [size] * (k == len(free))
            assert (k, size - free[k]) == (b, o)
            free[k] -= n


def check(rows, texts, size=4096):
    tok = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            piece = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            at += r.length
        assert at == len(ids)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return by_sequence


def test_round_trip_and_little_padding(spark, tmp_path):
    rng = random.Random(8)
    odd = ["It's <|endoftext|> we'll ÉTÉ é  x y 12 ½ ΣΑΣ 한국어 !!??", "́start", "ẞ İ ﬁ", prose(rng, 6000)]
    texts = corpus() + odd + [prose(rng, rng.randrange(1, 700)) for _ in range(60)]
    documents(spark, texts, str(tmp_path))
    rows = op6_packing(spark, str(tmp_path)).collect()
    by_sequence = check(rows, texts)
    assert len(by_sequence) <= 1.02 * sum(r.length for r in rows) / 4096 + 1


def test_several_groups_repeated_rows_and_empty_table(spark):
    docs = documents(spark, corpus())
    rows = pack_documents(docs, size=50, group_rows=9).collect()
    check(rows, corpus(), 50)
    same = docs.limit(1).unionByName(docs.limit(1)).selectExpr("doc_id", "'a b c' text", "1 key", "2 `group`", "3 length")
    got = pack_documents(same).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 2
    assert pack_documents(docs.where("false")).collect() == []


def test_parts_change_no_id():
    import pyarrow as pa

    from logweave.llm.kernels import text_bytes
    from logweave.llm.packing import Known, tokenise

    rng = random.Random(9)
    tok = Tokenizer.from_file(tokenizer_path())
    known = Known(tok, most=300)
    pieces = ["a", "Z", "ab", "0", "12", "'", "'s", "<", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "é", "́", " ", " ", "K", "ß", "İ", "中", "·", ".", ",", "!!", "_", "\x00", "\x1f", "\x85", " ", "\t", "\n", "😀"]
    for _ in range(20):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(60)]
        ids, off = tokenise(*text_bytes(pa.array(texts)), known, 2)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_words_that_collide_in_polynomials_have_their_own_ids(spark):
    texts = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), "q" * 9000, "q" * 9001]
    check(pack_documents(documents(spark, texts)).collect(), texts)
