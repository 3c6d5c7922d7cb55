import pyarrow as pa
import pytest
import sentencepiece

from gauntlet.llm import sentencepiece_codec as codec
from gauntlet.llm.common import read_table
from llm_helpers import CLASHING, docs


def test_parity_and_round_trip(spark):
    table = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = codec.encode_texts(table).join(table.select("doc_id", "text"), "doc_id").collect()
    other = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    assert len(rows) == table.count() and all(r.round_trip for r in rows)
    for r, ids in zip(rows, other.encode([r.text for r in rows])):
        assert r.ids == ids and r.n_tokens == len(ids)


def test_edge_cases(spark):
    texts = [*codec.PROBES, None, "x y " * 50000, "▁▁ a▁b ▁", " \n \t ", "ñ" * 3000]
    rows = list(enumerate(texts)) + [(0, "again"), (None, "no id")]
    encoded = codec.encode_texts(docs(spark, rows, CLASHING), threads=2)
    got = encoded.collect()
    assert len(got) == len(rows)
    other = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    by = {r.doc_id: r for r in got if r.doc_id not in (0, None)}
    for i, text in enumerate(texts[1:], 1):
        if text is None:
            assert (by[i].ids, by[i].n_tokens, by[i].round_trip) == (None, 0, None)
        else:
            assert by[i].ids == other.encode(text), text[:40]
            assert by[i].round_trip == ("▁" not in text)          # the marker itself reads back as a space
    back = {r.doc_id: r.text for r in codec.decode_ids(encoded.where("doc_id > 0")).collect()}
    assert all(back[i] == (t and t.replace("▁", " ")) for i, t in enumerate(texts) if i)
    assert codec.encode_texts(docs(spark, [], CLASHING)).count() == 0


def test_unigram_model_is_rebuilt(tmp_path):
    """A hand-made unigram model: scores, byte fallback and white-space rules follow the protobuf."""
    proto = codec.parse_model(codec.MODEL_PATH)
    del proto.pieces[:]
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", -20, 6) for b in range(256)),
                               ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -4.2, 1), ("▁a", -4.0, 1), ("ba", -7.0, 1), ("▁ab", -5.5, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    codec.verify_parity(codec.build_tokenizer(path), path, ["ab", "a  b ab", "  abba", "aé b", "bbbaaa", "", "ab ab  ab "])
    proto.trainer_spec.model_type = 3
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    with pytest.raises(ValueError):
        codec.build_tokenizer(path)


def test_parity_check_refuses_a_wrong_tokenizer():
    tokenizer = codec.build_tokenizer(codec.MODEL_PATH)
    tokenizer.normalizer = None
    with pytest.raises(ValueError):
        codec.verify_parity(tokenizer, codec.MODEL_PATH, ["two words"])


def test_texts_leave_arrow_in_parts():
    texts = [None, "", "é" * 40, "ab", None, "c" * 300, "d" * 10, *["e" * 9] * 50]
    parts = list(codec._slices(pa.array(["x", *texts]).slice(1), 100))
    assert [t for _, part in parts for t in part] == texts and len(parts) > 5
    assert [i for i, _ in parts] == [sum(len(p) for _, p in parts[:n]) for n in range(len(parts))]
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= 100 for _, part in parts)
    assert list(codec._slices(pa.array([], pa.string()), 100)) == []


def test_few_words_are_encoded_at_once(monkeypatch):
    monkeypatch.setattr(codec, "AT_ONCE", 7)
    whole, coder, sizes = codec.Coder(codec.MODEL_PATH), codec.Coder(codec.MODEL_PATH), []
    own = coder.words

    class Counted:
        decode_batch = own.decode_batch

        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return own.encode_batch_fast(words, **options)

    coder.words = Counted()
    texts = [" ".join(f"word{i * j}" for j in range(20)) for i in range(20)]
    assert coder(texts) == whole(texts) and len(sizes) > 5 and max(sizes) <= 7
