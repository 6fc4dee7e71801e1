"""Cross-tokenizer alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attrition.llm.alignment import OUTPUTS, aligned, overlaps
from attrition.llm.queries import ALIGNED_FILES, op12_alignment

P = public_tokenizers.path


@pytest.fixture(scope="module")
def plain():
    """Token ids and token bytes of a text by the two libraries themselves."""
    a = Tokenizer.from_file(P("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P("piece_bpe_32k.model"))
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in plain_bytes} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain_bytes)}

    def tokens(text):
        if not text:
            return [], []
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ib = b.encode(text)
        ta = [(i, bytes(alphabet[ch] for ch in a.id_to_token(i))) for i in ia]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ib]
        whole = (" " + text).encode()
        return (ta, tb) if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb) else ([], [])
    return tokens


def brute(texts, plain):
    docs = []
    for text in texts:
        ta, tb = plain(text)
        spans = []
        for side in (ta, tb):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(spans[0]) < 400 else _swept(*spans)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans) if len(cuts) < 600 else (lo, hi))
            lo = hi
        if len(cuts) >= 600:
            by = [np.searchsorted(cuts, [e for _, _, e in side]) for side in spans]
            parts = [["", ""] for _ in cuts]
            for k in (0, 1):
                for g, (i, _, _) in zip(by[k], spans[k], strict=True):
                    parts[g][k] += ("," if parts[g][k] else "") + str(i)
            groups = ["|".join(x) for x in parts]
        docs.append((len(ta), len(tb), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""))
    count = Counter(x for d in docs for x in d[3])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(d[0], d[1], d[2], len(d[3]), sum(count[x] == top[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


def _swept(a, b):
    out, j = [], 0
    for i, s, e in a:
        while j and b[j - 1][2] > s:
            j -= 1
        while j < len(b) and b[j][1] < e:
            if b[j][2] > s:
                out.append((i, b[j][0]))
            j += 1
    return out


ODD = [None, "", " ", "  two  spaces ", "▁ literal", "<|endoftext|> in </s> text <unk> <0x0A>", "tab\tline\n\n break\r\n", "żółć 漢字かな交じり 🙂🙂 नमस्ते",
       "a" * 5000, "nb sp wide​zero", "it's we'll I'M 12345,67.8", "\x00nul\x1c\x85", "same text", "same text", "é combining"]


def rows(found):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in OUTPUTS)) for r in found)


def test_odd_texts(spark, make_docs, plain):
    docs = make_docs([(k, t) for k, t in enumerate(ODD)], extra="n_a")
    want = sorted((k, *x) for k, x in enumerate(brute(ODD, plain)))
    assert rows(aligned(docs, ALIGNED_FILES, work=7, block_bytes=40, piece_chars=5).collect()) == want
    assert rows(aligned(docs, ALIGNED_FILES, keep=("doc_id", "n_a")).collect()) == want


def test_query_on_the_table(spark, docs, plain):
    table = docs.orderBy("doc_id").collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(table, brute([r["text"] for r in table], plain), strict=True))
    found = op12_alignment(spark, "/root/testdata/sf0.001").collect()
    assert rows(found) == want
    assert sum(r["n_best"] for r in found) > 0


def test_null_id_empty_table_and_long_text(spark, make_docs, plain):
    assert aligned(make_docs([(1, "x")]).filter("doc_id < 0"), ALIGNED_FILES).collect() == []
    long = "the quick brown fox, jumps over 12 lazy dogs\n " * 20000 + "x" * 30000
    got = aligned(make_docs([(None, long), (None, long)]), ALIGNED_FILES).collect()
    assert rows(got) == sorted((-1, *x) for x in brute([long, long], plain))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 9))
def test_merge_path_pieces_equal_the_whole_merge(x, y, work):
    total = max(sum(x), sum(y))
    a, b = np.cumsum([*x, total - sum(x) + 1]), np.cumsum([*y, total - sum(y) + 1])
    end, at, bt, shared = overlaps(a, b, work)
    assert end.tolist() == sorted({*a.tolist(), *b.tolist()})
    assert end[shared].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    starts = [np.concatenate([[0], e[:-1]]) for e in (a, b)]
    want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]]
    assert sorted(zip(at.tolist(), bt.tolist(), strict=True)) == want
