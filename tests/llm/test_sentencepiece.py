import pytest
import sentencepiece

from kalends.llm.encoder import public
from kalends.llm.sentencepiece_codec import UNIGRAM, Codec, decode, encode, round_trip

from .test_tokens import ODD

DATA = [t or "" for t in ODD] + ["The quick brown fox. " * 20, " x", "x ", "a▁b ▁▁", "aaaaaaaaaaa bbbbb    ", "internationalization unbelievableness zzzzqqqq", "\x00", "Ünïcödé ñandú straße", "🤖" * 3]


def files():
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(public("piece_bpe_32k.model"), "rb") as f:
        bpe = f.read()
    proto = pb.ModelProto()
    proto.ParseFromString(bpe)
    proto.trainer_spec.model_type = UNIGRAM
    for p in proto.pieces:  # scores that single precision adds up exactly
        p.score = max(p.score, -40000.0)
    unigram = proto.SerializeToString()
    proto.trainer_spec.byte_fallback = False
    for p in list(proto.pieces):
        if p.type == 6:
            p.type = 3
    return {"bpe": bpe, "unigram": unigram, "no bytes": proto.SerializeToString()}


@pytest.mark.parametrize("name", ["bpe", "unigram", "no bytes"])
def test_equals_library(name):
    import pyarrow as pa

    model = files()[name]
    own, library = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, counts = own.encode(pa.array(DATA))
    end = 0
    for text, n in zip(DATA, counts.tolist(), strict=True):
        got = ids[end : end + n].tolist()
        end += n
        assert got == library.encode(text), text
        assert own.decode(got) == library.decode(got)


def test_columns_round_trip(spark, texts):
    rows = [*enumerate(ODD), (None, "null id"), (1, None)]
    path = public("piece_bpe_32k.model")
    ids = encode(texts(rows), path)
    assert sorted(map(tuple, decode(ids, path).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert all(r.same for r in round_trip(texts(rows), path).collect())
    assert encode(texts([]), path).collect() == []
