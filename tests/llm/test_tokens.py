"""Token counts and packing: equality with the libraries, exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recallscope.llm import tokenizing
from recallscope.llm.token_counts import token_counts
from recallscope.llm.vector_packing import Limits, pack, vector_pack
from tests.conftest import SF001
from tests.llm.util import ODD_TEXTS, empty_docs, odd_docs

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
TRICKY = ["", "  ", "a\x01b \x01 c", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a  b\n\n c\t", "it's IT'S don't. no,yes.",
          "H̱ ẖ é. É, Ǆ ǅ ß ẞ ſ ﬁ Ⅷ ½ x²", "İstanbul ΣΑΣ. στους", "x" * 3000, " lead", "trail ", "a ▁b c",
          "你好, 世界. \U0001f600. b\x1cc d\x85e f g", "Wort. wort, WORT. Wort.,", "한국어 각. ท่า", "1.5 2, 3"]
letters = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aZé ñ.,'\t\n")), max_size=40)


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name):
    e = tokenizing.Encoder(public_tokenizers.path(name))
    texts = TRICKY + [t or "" for _, t in ODD_TEXTS]
    for _ in range(2):  # the second time from the table
        want = e.encode(texts)
        assert [x.tolist() for x in e.ids([t.encode() for t in texts])] == [list(w) for w in want]
        assert e.counts([t.encode() for t in texts]).tolist() == [len(w) for w in want]
    assert e.ids([]) == [] and e.counts([]).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, min_size=1, max_size=6))
def test_any_text(texts):
    e = tokenizing.encoder(public_tokenizers.path(FILES[0]))
    assert [x.tolist() for x in e.ids([t.encode() for t in texts])] == [list(w) for w in e.encode(texts)]


def test_the_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenizing, "TABLE_PIECES", 10)
    e = tokenizing.Encoder(public_tokenizers.path(FILES[0]))
    texts = [t or "" for _, t in ODD_TEXTS]
    want = [len(w) for w in e.encode(texts)]
    assert [int(e.counts([t.encode()])[0]) for t in texts] == want and len(e.codes) < 6000


@pytest.mark.parametrize("name", FILES)
def test_token_counts(spark, name):
    docs = odd_docs(spark, extra=("n_bytes", "more"))
    path = public_tokenizers.path(name)
    got = token_counts(docs.withColumnRenamed("more", "copy"), path, limit=50)
    assert got.columns == ["doc_id", "copy", "n_bytes", "n_tokens", "over_limit"]
    e = tokenizing.encoder(path)
    want = sorted((str(i), len((t or "").encode()), len(e.encode([t or ""])[0])) for i, t in ODD_TEXTS)
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 50) for r in rows)
    assert token_counts(empty_docs(spark), path).collect() == []


def check_pieces(pieces, lengths, prompts, limits):
    """Every token once, offsets gapless from 0, limits kept; the sequences' fill."""
    cover = [np.zeros(n, int) for n in lengths]
    sequences = {}
    for i, start, n, s, offset in pieces:
        assert n > 0
        cover[i][start : start + n] += 1
        sequences.setdefault(s, []).append((offset, n, max(0, n - max(0, min(prompts[i] - start, n)))))
    assert all((c == 1).all() for c in cover)
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss
    return sum(lengths) / (len(sequences) * limits.tokens) if sequences else 1.0


@pytest.mark.parametrize("limits,least", [(Limits(), 0.99), (Limits(2048, 4, 2048), 0.9), (Limits(64, 3, 40, 4), 0), (Limits(2048, 4, 1024), 0)])
def test_packing(limits, least):
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 3000, 400), [1, 2048, 2049, 10_000]])
    prompts = np.minimum(rng.integers(0, 400, len(lengths)), lengths - 1) * (rng.random(len(lengths)) < 0.4)
    prompts = prompts if least == 0 else prompts * 0
    pieces = pack(lengths, prompts, limits)
    assert check_pieces(pieces.tolist(), lengths.tolist(), prompts.tolist(), limits) >= least
    assert (pack(lengths, prompts, limits) == pieces).all()
    assert len(pack(np.zeros(0, np.int64), np.zeros(0, np.int64), limits)) == 0


def test_vector_pack_round_trip(spark):
    path = public_tokenizers.path(FILES[0])
    e = tokenizing.encoder(path)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = vector_pack(docs, path, group_bytes=100_000).collect()
    back = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length == r.loss_tokens
        back.setdefault(r.doc_id, {})[r.start] = ids
    for r in docs.collect():
        ids = np.concatenate([back[r.doc_id][s] for s in sorted(back[r.doc_id])])
        assert ids.tolist() == [*e.encode([r.text])[0], 1]
    ids = sorted(back)
    place = {d: i for i, d in enumerate(ids)}
    lengths = [sum(map(len, back[d].values())) for d in ids]
    assert {(r.doc_id, r.doc_tokens) for r in got} == set(zip(ids, lengths))
    fill = check_pieces([(place[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in got], lengths, [0] * len(ids), Limits())
    assert fill > 0.97
    from recallscope.llm.queries import op6_vector_packing

    crcs = {(r.doc_id, r.start): r.ids_crc32 for r in op6_vector_packing(spark, SF001).collect()}
    for (d, s), crc in crcs.items():
        whole = np.concatenate([back[d][k] for k in sorted(back[d])])
        ends = [k[1] for k in crcs if k[0] == d and k[1] > s]
        assert crc == zlib.crc32(whole[s : min(ends, default=len(whole))].astype("<u4").tobytes())


def test_prompts_bear_no_loss_and_odd_texts(spark):
    path = public_tokenizers.path(FILES[0])
    e = tokenizing.encoder(path)
    docs = odd_docs(spark, extra=("start", "prompt")).selectExpr("*", "'ask me'  as ask")
    limits = Limits(256, 4, 128, 4)
    got = vector_pack(docs, path, prompt_col="ask", limits=limits, group_rows=5).collect()
    prompt = len(e.encode(["ask me"])[0])
    want = sum(len(e.encode([t or ""])[0]) + 1 + prompt for _, t in ODD_TEXTS)
    assert sum(r.length for r in got) == want
    assert sum(r.loss_tokens for r in got) == want - prompt * len(ODD_TEXTS)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        assert sum(p.length for p in parts) <= 256 and len(parts) <= 4 and sum(p.loss_tokens for p in parts) <= 128
    assert vector_pack(empty_docs(spark), path).collect() == []
    assert {r.doc_id for r in got if r.doc_tokens == prompt + 1} >= {4, 5, 6}  # null, empty, blank: prompt and end
