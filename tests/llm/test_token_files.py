import zlib

import numpy as np
from tokenizers import Tokenizer

from kalends.llm.encoder import public
from kalends.llm.token_files import PerfectHash, TokenFiles, mix, write_token_files


def test_perfect_hash_is_minimal():
    keys = mix(np.arange(10_000, dtype=np.uint64), 3)
    assert sorted(PerfectHash.build(keys)(keys).tolist()) == list(range(10_000))
    assert PerfectHash.build(keys[:0])(keys[:3]).tolist() == [-1, -1, -1]


def test_files_round_trip(spark, texts):
    library = Tokenizer.from_file(public("byte_bpe_50k.json"))
    rows = [(9, "Hello  world"), (2, None), (5, "A b\n\nc " * 50), (5, "other"), (7, "<|endoftext|>"), (None, "none"), (None, "none"), (None, None), (-3, "é 日本"), (2**60 + 1, "large id")]
    rows += [(100 + i, f"text {i} " * (i % 5)) for i in range(60)]
    files, keys = write_token_files(texts(rows), public("byte_bpe_50k.json"))
    got = {(r.doc_id, r.occurrence): r for r in files.read(keys).collect() if r.doc_id is not None}
    files = TokenFiles(files.path)  # as another session opens it
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append(library.encode(text or "", add_special_tokens=False).ids + [2])
    absent = [r for r in files.read(keys).collect() if r.doc_id is None]
    start = sum(r.n_tokens for r in absent)
    assert sorted(r.n_tokens for r in absent) == sorted(map(len, ids[None])) and min(r.start for r in absent) == 0
    assert files.get(spark, None, 1, "none").tolist() == files.get(spark, None, 0, "none").tolist() == library.encode("none", add_special_tokens=False).ids + [2]
    assert files.get(spark, None, 2, "none") is None
    for doc in sorted(k for k in ids if k is not None):
        have = [got[doc, k] for k in range(len(ids[doc]))]
        crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
        assert sorted(r.ids_crc32 for r in have) == sorted(map(crc, ids[doc]))
        for r in have:
            assert r.start == start
            start += r.n_tokens
            assert crc(files.get(spark, doc, r.occurrence)) == r.ids_crc32
    assert len(got) + len(absent) == sum(map(len, ids.values())) == files.documents
    assert files.get(spark, 12345) is None
    files, keys = write_token_files(texts([]), public("byte_bpe_50k.json"))
    assert files.read(keys).count() == 0
