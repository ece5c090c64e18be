"""Token alignment against a plain version with both reference libraries."""

import collections
import hashlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
VOCABULARY, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(coders, rows):
    """rows: (doc_id, text); results of op13 in the order of the rows."""
    a, b = coders
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    docs, count = [], collections.Counter()
    for doc, text in rows:
        got, links, groups = None, [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(sign[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                at_a, at_b = spans(bytes_a), spans(bytes_b)
                common = sorted({e for _, e in at_a} & {e for _, e in at_b})
                start = 0
                for end in common:
                    groups.append(([i for i, (s, e) in zip(ids_a, at_a) if start <= s and e <= end], [i for i, (s, e) in zip(ids_b, at_b) if start <= s and e <= end]))
                    start = end
                links = [(x, y) for x, (s, e) in zip(ids_a, at_a) for y, (t, f) in zip(ids_b, at_b) if s < f and t < e]
                got = (len(ids_a), len(ids_b))
        count.update(links)
        docs.append((doc, got or (0, 0), groups, links))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for doc, (n_a, n_b), groups, links in docs:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if said else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and lines\r\n"), (5, "marks ▁ are ▁spaces"), (6, "<|endoftext|> <s> </s> [INST] <0x41> <unk>"),
    (7, "\U0001f600\U0001f468‍\U0001f469 ÄÖ 中文字 हिन्दी"), (None, "no id here"), (8, "same text"), (8, "same text"), (9, "same text"),
    (10, "x" * 3000), (11, "don't you're we'll 1234567 ...!!! \x00\x01"), (12, "wort " * 500 + "ß" * 40),
]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def key(row):
    return tuple((x is not None, x) for x in row)


def test_odd_texts_and_clashing_columns(spark, coders):
    from weighbridge.llm.token_alignment import alignment

    docs = spark.createDataFrame([(i, t, "clash", "clash", 5) for i, t in ODD], "doc_id long, text string, a string, __row string, n_links int")
    with open(VOCABULARY, "rb") as f, open(MODEL, "rb") as g:
        got = alignment(docs.repartition(3), f.read(), g.read())
    assert got.columns == list(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(coders, ODD), key=key)


def test_query_on_whole_table(spark, coders):
    from weighbridge.llm.token_alignment import op13_token_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 6000]
    assert len(rows) > 150
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from weighbridge.llm import token_alignment as t

    with open(VOCABULARY, "rb") as f, open(MODEL, "rb") as g:
        got = t.alignment(docs, f.read(), g.read())
    assert sorted(map(tuple, got.collect())) == sorted(plain(coders, rows))
    whole = op13_token_alignment(spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and whole.filter("n_links <> n_a + n_b - n_groups").count() == 0


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_any_size_agree(piece):
    from weighbridge.llm.token_alignment import merge_path

    rng = np.random.default_rng(piece)
    a, b, a_at, b_at = [], [], [0], [0]
    for _ in range(40):
        last = int(rng.integers(1, 60))
        for ends, at in ((a, a_at), (b, b_at)):
            own = sorted({*rng.integers(1, last + 1, int(rng.integers(0, last + 1))).tolist(), last})
            ends += own
            at.append(at[-1] + len(own))
        if rng.random() < 0.2:  # a text without tokens
            a_at.append(a_at[-1])
            b_at.append(b_at[-1])
    i, j, g = merge_path(np.array(a), np.array(b), np.array(a_at), np.array(b_at), piece)
    want, group = [], 0
    for s, e, t, f in zip(a_at, a_at[1:], b_at, b_at[1:]):
        x, y = s, t
        while x < e and y < f:
            want.append((x, y, group))
            step = (a[x] <= b[y], b[y] <= a[x])
            group += all(step)
            x, y = x + step[0], y + step[1]
    assert list(zip(i.tolist(), j.tolist(), g.tolist())) == want


def test_pair_counts_beyond_broadcast(spark, coders, monkeypatch):
    from weighbridge.llm import token_alignment as t

    monkeypatch.setattr(t, "broadcast_if_small", lambda df, *_: df.hint("merge"))
    with open(VOCABULARY, "rb") as f, open(MODEL, "rb") as g:
        got = t.alignment(spark.createDataFrame(ODD, "doc_id long, text string"), f.read(), g.read())
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(coders, ODD), key=key)
