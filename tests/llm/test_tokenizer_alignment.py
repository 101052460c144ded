import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import prose
from tokenizers import Tokenizer

from shelfmark.llm.token_counts import byte_letters
from shelfmark.llm.tokenizer_alignment import Aligner, align_texts, align_tokenizers, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A, LIBRARY_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
LIBRARY_A.encode_special_tokens = True
LETTERS = byte_letters()
SPECIAL = {v: k for k, v in LIBRARY_A.get_vocab().items()}


def bytes_a(i):
    return bytes(LETTERS[c] for c in SPECIAL[i])


def bytes_b(i):
    piece = LIBRARY_B.id_to_piece(i)
    if piece.startswith("<0x") and len(piece) == 6:
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute_text(text):
    """(a ids, b ids, groups, links) of a text encoded whole; empty where the bytes differ."""
    if not text:
        return [], [], [], []
    a, b = LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, LIBRARY_B.encode(text)
    raw_a, raw_b, whole = list(map(bytes_a, a)), list(map(bytes_b, b)), (" " + text).encode()
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return [], [], [], []
    sa, sb = spans(raw_a), spans(raw_b)
    links, j = [], 0
    for i, (lo, hi) in enumerate(sa):
        while sb[j][1] <= lo:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < hi:
            links.append((a[i], b[k]))
            k += 1
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, i, j = [], 0, 0
    for cut in cuts:
        group = [], []
        while i < len(a) and sa[i][1] <= cut:
            group[0].append(a[i])
            i += 1
        while j < len(b) and sb[j][1] <= cut:
            group[1].append(b[j])
            j += 1
        groups.append(group)
    return a, b, groups, links


def shown(groups):
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return hashlib.sha256(text.encode()).hexdigest() if groups else ""


def brute(rows):
    known = {t: brute_text(t) for _, t in rows}
    counts = Counter(link for _, t in rows for link in known[t][3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (key, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links),
         sum(counts[x] for x in links), shown(groups))
        for key, t in rows
        for a, b, groups, links in [known[t]]
    ]


ODD = [
    "a  b", "  lead", " x", "tail ", "a\tb\n\nc ", "<|endoftext|> <s> x</s>", "a▁x and more words", "▁",
    "café 你好 \U0001f600\U0001f600 x", "a b　c ① d", "x\x00y", "I'll 'tis we've   done", "\r\n", " ",
    "don't\x1c stop \x85 now", "a ▁ b", "▁ ▁a b c",
]
ALIGNER = Aligner(A, B, kept_bytes=20_000, chunk=7, joined_chars=9)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,abesté▁你"), st.characters(codec="utf-8")), max_size=50))
def test_any_text_aligns_as_when_encoded_whole(text):
    a, b, groups, links = brute_text(text)
    found = ALIGNER.align(text) if text else None
    if not a:
        assert found is None
        return
    pairs, times = found[5], found[6]
    assert found[:5] == (len(a), len(b), len(groups), len(links), shown(groups))
    assert dict(zip(pairs.tolist(), times.tolist())) == Counter(x * ALIGNER.width + y for x, y in links)


@pytest.fixture(scope="module")
def docs(spark, edge):
    rows = [(400 + i, t) for i, t in enumerate(ODD)] + [(500 + i % 7, prose(3, 60)) for i in range(40)]
    return edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("bounds", [{}, {"head_pairs": 30, "heavy_texts": 4}, {"head_pairs": 1, "heavy_texts": 1}])
def test_rows_of_every_kind(spark, docs, bounds):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, align_tokenizers(docs, A, B, **bounds).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_each_distinct_text_is_one_row(docs):
    aligned = align_texts(docs, A, B)
    rows = [r["text"] for r in docs.collect() if r["text"] is not None]
    assert sorted(r["copies"] for r in aligned.collect()) == sorted(Counter(rows).values())
    counts = {(r["a"], r["b"]): r["n"] for r in pair_counts(aligned, ALIGNER.width).collect()}
    assert counts == Counter(link for t in rows for link in brute_text(t)[3])


def test_clashing_columns(spark):
    table = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id long, body string, digest string, copies long, _key long")
    assert tuple(align_tokenizers(table, A, B, text="body").first()) == brute([(1, "a b")])[0]


def test_empty_table(nothing):
    result = align_tokenizers(nothing, A, B)
    assert result.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert result.count() == 0
