import struct

import public_tokenizers as P
import regex
from tokenizers import Tokenizer

from readloom.llm import pretokens, token_store
from readloom.llm.common import fresh_dir
from tests.llm import brute

PATH = P.path("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def expected(rows):
    ids, start, out = library(), 0, []
    for i, t in rows:
        x = ids(t)
        out.append((i, start, len(x), brute.crc(x)))
        start += len(x)
    return out


def test_query_equals_the_library(spark, sf, docs):
    got = sorted(map(tuple, token_store.op1_token_store(spark, sf).collect()))
    assert got == expected(docs)


def test_odd_rows(spark, odd, odd_rows):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    manifest = token_store.write_token_shards(odd, fresh_dir(spark, "t"), PATH)
    got = sorted(map(tuple, token_store.read_token_shards(manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    empty = token_store.write_token_shards(odd.limit(0), fresh_dir(spark, "t"), PATH)
    assert empty.count() == 0 and token_store.read_token_shards(empty).count() == 0


def test_short_document_access(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    path = token_store.write_token_shards(rows, fresh_dir(spark, "t"), PATH).orderBy("part").first().path
    shard = token_store.ShardReader(path)
    ids = library()
    for i in (0, len(shard) - 1):
        assert shard.ids(i).tolist() == ids(dict(docs)[int(shard.keys[i])])
    assert shard.sha != "" and len(shard) > 1


def test_dictionary_shrinks_short_documents():
    import zstandard

    samples = [struct.pack("<40H", *[(7 * i + j * j) % 900 for j in range(40)]) for i in range(400)]
    d = token_store.train_dictionary(samples)
    assert d
    plain = zstandard.ZstdCompressor(level=3)
    shared = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d))
    assert sum(len(shared.compress(s)) for s in samples) < sum(len(plain.compress(s)) for s in samples)


def test_any_id_gives_a_dictionary(spark):
    import zstandard

    for few in ([b"\1\0"], [b"12345678"], [b"\1\0" * 9000], [b"12", b"34", b""]):
        d = token_store.train_dictionary(few)
        assert d
        packed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(few[0])
        assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)).decompress(packed) == few[0]
    assert token_store.train_dictionary([]) == token_store.train_dictionary([b""]) == b""
    one = spark.createDataFrame([(-(1 << 63), "a text"), (None, "another")], "doc_id long, text string")
    manifest = token_store.write_token_shards(one, fresh_dir(spark, "t"), PATH)
    assert all(token_store.ShardReader(r.path).sha == r.dict_sha256 != brute.sha("") for r in manifest.collect())
    assert sorted(map(tuple, token_store.read_token_shards(manifest).collect()), key=lambda r: r[1]) == expected([(None, "another"), (-(1 << 63), "a text")])


def test_special_strings_are_the_librarys():
    encode = token_store.piece_encoder(open(PATH, "rb").read(), 2)
    assert struct.unpack("<4H", encode(["hello <|endoftext|> world"])[0]) == (31373, 220, 50256, 995)


def test_fast_split_is_the_pattern_on_steady_text():
    slow = regex.compile(P.PATTERN).findall
    steady = "".join(c for c in map(chr, range(0x20000)) if pretokens.is_steady(c))
    for k in range(0, len(steady), 50):
        s = steady[k : k + 50]
        for text in (s, " ".join(s), f"a{s} 1{s}'s{s}  ", "x'" + "'ll ".join(s) + "\n \n"):
            assert pretokens._FAST(text) == slow(text)


def test_special_token_text_and_unsteady_text():
    ids = library()
    encode = token_store.piece_encoder(open(PATH, "rb").read(), 2)
    for t in ("<|endoftext|> a", "\x1c\x1d x y \U0001f600̀ n b", "it's  \t\n end  ", " a b c" * 700):
        assert struct.unpack(f"<{len(ids(t)) - 1}H", encode([t])[0]) == tuple(ids(t)[:-1])
