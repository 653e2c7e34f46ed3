import hashlib
import random

import pytest
import sentencepiece as S
from sentencepiece import sentencepiece_model_pb2 as pb

from causeway.llm import piece_codec as P
from causeway.llm.registry import QUERIES

TEXTS = ["", " ", "  ", "a", " a", "a  b   c", "tab\tand\nline\r\n", "▁", "a▁ b", "héllo wörld", "日本語のテキスト", "🙂🙃 x",
         "<0x41> <s> </s> <unk>", "x" * 3000, "ab" * 2000 + " " * 70 + "end ", "\x00\x01 z", "é 　x", "1234567890 3.14"]


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.default_model())


@pytest.fixture(scope="module")
def library():
    return S.SentencePieceProcessor(model_file=P.default_model())


def test_ids_spans_and_texts_are_the_library_s(codec, library):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab ▁éß日.\n🙂XYZ12") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        raw = text.encode()
        ids, borders = codec.encode(raw)
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [p.id for p in proto.pieces] == library.encode(text), text
        for p, span in zip(proto.pieces, zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True), strict=True):
            if not library.is_byte(p.id):  # the library gives a character's span to the last of its bytes
                assert span == (p.begin, p.end), text
        assert not text or (borders[0] == 0 and borders[-1] == len(raw) and (borders[1:] >= borders[:-1]).all())
        assert codec.decode([*ids.tolist(), codec.end]) == library.decode([*ids.tolist(), codec.end]), text
    for _ in range(300):  # any ids, broken bytes among them
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 2]) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_normalisation_through_a_compiled_map(rule):
    library = S.SentencePieceNormalizer(rule_name=rule)
    model = pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    rng = random.Random(5)
    letters = "aÀß ﬁⅣ①ｱ゛　 \t\n日é本Å🙂​ĳ½㌀"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    for squeeze in (True, False):
        for prefix in (True, False):
            model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
            library = S.SentencePieceNormalizer(model_proto=model.SerializeToString())
            own = P.Normalizer(model.normalizer_spec)
            for text in texts:
                got, place = own(text.encode())
                want, offsets = library.normalize(text, with_offsets=True)
                assert got == want, (text, squeeze, prefix)
                assert len(place) == len(got.encode()) + 1
                if text and got:
                    starts = [0]
                    for c in got:
                        starts.append(starts[-1] + len(c.encode()))
                    assert [len(text.encode()[:place[b]].decode()) for b in starts] == list(offsets), (text, squeeze, prefix)


def test_tables_with_edge_cases(spark, library):
    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(None, "a b", 1), (7, None, 2), (7, None, 2), (8, "word " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long").selectExpr("*", "text AS _text", "1 AS begins")
    out = P.encode(df, decoded=True).collect()
    assert len(out) == len(rows)
    for r, (i, t, _) in zip(sorted(out, key=lambda r: (repr(r.doc_id), len(r.ids))), sorted(
            rows, key=lambda r: (repr(r[0]), len(library.encode(r[1] or ""))))):
        assert (r.doc_id, r.ids, r.decoded) == (i, [*library.encode(t or ""), 2], library.decode(library.encode(t or "")))
        assert len(r.begins) == len(r.ends) == len(r.ids) and r.ends[-1] == len((t or "").encode())
    with pytest.raises(ValueError):
        P.encode(df, keep=("doc_id", "begins"))
    assert P.encode(df.where("false")).count() == 0
    ids = spark.createDataFrame([(1, [2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in P.decode(ids).collect()} == {1: "", 2: None, 3: ""}
    back = {r.doc_id: r.decoded for r in P.decode(P.encode(df.where("doc_id = 8 AND size IS NULL"))).collect()}
    assert back == {8: "word " * 20_000}


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_piece_codec"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
